"""Join helpers: size-checked broadcast and salted equi-joins for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest planned size of a table that is broadcast on request.
BROADCAST_MAX_BYTES = 32 << 20


def planned_bytes(df: DataFrame) -> int:
    """Size that the optimizer expects of ``df`` (file sizes for scans); runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` if its planned size is at most ``max_bytes``; else the plain DataFrame, whose
    joins shuffle (or are broadcast by AQE from measured sizes)."""
    if planned_bytes(df) <= max_bytes:
        return F.broadcast(df), True
    return df, False


def held_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in memory, about: a broadcast holds them, and files may be far smaller (bitmaps and
    repeated keys by a factor of twenty and more). Runs a job over ``df``, for written intermediates."""
    def of(c, kind):
        if kind.typeName() in ("string", "binary"):
            return F.octet_length(c)
        if kind.typeName() == "array":
            return 16 + F.size(c) * (8 if kind.elementType.typeName() in _FIXED else 64)
        return F.lit(0 if kind.typeName() in _FIXED else 64)
    row = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        row = row + F.coalesce(of(F.col(f"`{f.name}`"), f.dataType), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


_FIXED = ("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp")


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a written ``df`` takes at most ``max_bytes`` in memory (its files are looked at first, and read only if small)."""
    return planned_bytes(df) <= max_bytes and held_bytes(df) <= max_bytes


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salts: int, how: str = "inner",
                residual: Column | None = None) -> DataFrame:
    """Equi-join where a few keys of ``big`` are hot: ``big`` rows get a salt in [0, salts)
    from a hash of the whole row (deterministic, so a retried task sees the same salts),
    ``small`` rows are copied once per salt, and the join key gains the salt. Each hot key
    is then spread over ``salts`` tasks instead of one."""
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = [b[c] == s[c] for c in on] + [b["_salt"] == s["_salt"]]
    if residual is not None:
        cond.append(residual)
    out = b.join(s, cond, how)
    return out.drop(b["_salt"]).drop(s["_salt"])


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` by hash of ``cols`` over ``spark.sql.shuffle.partitions`` tasks. Adaptive execution joins partitions of few
    bytes into one task; those named here stay, for small rows that take much work each (bitmaps, draws)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


#: Input bytes of a task of ``sized``.
TASK_BYTES = 8 << 20
MAX_TASKS = 20_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that ``df`` reads, a table read twice counting twice; those of unknown size are
    left out. Unlike ``planned_bytes`` a join does not multiply them. Runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def sized(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` by hash of ``cols`` over as many tasks as its input has ``TASK_BYTES``, ``spark.sql.shuffle.partitions`` at least.

    Aggregates by ``cols`` (or more) that follow need no other exchange, and what one task of theirs holds does not
    grow with the input: partitions of a fixed number do, and so do those that adaptive execution joins."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(max(n, -(-input_bytes(df) // TASK_BYTES)), max(n, MAX_TASKS)), *cols)


#: Folders that ``materialize`` has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Compute a reused intermediate once and cut its lineage: write it as Parquet under the
    session's shared checkpoint folder (``spark.checkpoint.dir`` on a cluster) and read it
    back. Unlike ``Dataset.checkpoint`` this computes the input a single time, survives
    executor loss, and the read-back carries real file sizes for broadcast decisions.

    Results are lazy, so the folders stay until ``release_materialized``."""
    import uuid

    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/turnwise-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def release_materialized(spark) -> int:
    """Delete what ``materialize`` has written in this application, once no result that reads it is needed any more
    (after a job has written its output). Returns the number of folders."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
