"""Shared helpers: reading tables, written intermediates, Arrow byte access for numpy operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import materialize

__all__ = ["documents", "labels", "materialize", "one_text_each", "small_batches", "smallest_hashes", "text_buffer", "row_slices", "without"]

SLICE_BYTES = 1 << 19
BATCH_ROWS = 1_000
MAX_GROUPS = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without input columns whose names (in any case) clash with an operator's output."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from now on in this session. Rows here are whole
    texts, so Spark's 10,000 a batch would hold tens of megabytes in each Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column and its row offsets (null rows are empty).

    Reads the Arrow buffers in place, so no Python string is made per row.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows each (a longer row is a range of its own)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def smallest_hashes(df: DataFrame, by: str, h: Column, per: int) -> DataFrame:
    """A training sample: of each group of ``by`` the ``per`` smallest distinct hashes ``h``, one row each
    (of rows that share group and hash the least value of every other column), numbered from 1 in ``at``.

    Distinct hashes are first estimated per group, so that rows repeated under one id count once. A row whose
    hash, as a share of all hashes, lies beyond twice ``per`` in its group's estimate is left out where it
    is read (the estimate is good to a few percent), so a task sorts a few times ``per`` rows of a group, however
    many the group has. Estimates of the ``MAX_GROUPS`` largest groups are broadcast; rows of smaller groups
    are all kept for the sort."""
    others = [c for c in df.columns if c != by]
    d = df.withColumn("_h", h).withColumn("_u", F.shiftrightunsigned("_h", 1).cast("double") / float(1 << 63))
    sizes = (d.groupBy(by).agg(F.approx_count_distinct("_h", 0.03).alias("_n"))
             .orderBy(F.desc("_n"), by).limit(MAX_GROUPS))
    near = d.join(F.broadcast(sizes), by, "left").filter(
        F.coalesce(F.col("_u") * F.col("_n") < 2 * per + 100, F.lit(True)))
    one = near.groupBy(by, "_h", "_u").agg(*[F.min(c).alias(c) for c in others])
    ranked = one.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy("_u", "_h")))
    return ranked.filter(F.col("at") <= per).drop("_u", "_h")


def one_text_each(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of the given ids (a bounded table without repeats): of an id that repeats the least text."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return named.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
