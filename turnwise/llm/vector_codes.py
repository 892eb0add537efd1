"""Vector code compression: product codes found by equal-average nearest-neighbour search.

Vectors become integers floor(scale * x) and are cut into equal parts; each part is replaced by the
index of the nearest entry of its position's codebook. The search of a part:

1. Entries are sorted by their component sum. A part starts at the place of its own sum and goes
   outward, the entry with the smaller sum gap first.
2. For any entry, (sum gap)^2 / dimension is a lower bound of the squared distance. A part stops as
   soon as this bound strictly exceeds its best distance; equal bounds are still looked at, so ties
   go to the lower index exactly.

All parts of a batch search at once in numpy; those that have stopped leave the batch. Codebooks
start at the vectors of the smallest ids. A round assigns all parts in the tasks and gives out one
count and one sum vector per entry and task (a table of parts x entries rows, whatever the number of vectors),
which Spark adds up; the driver divides them. All arithmetic is exact in 64-bit integers.

Edge cases: a vector that is null or holds a null or non-finite component is dropped; components
beyond ``limit(dimension)`` (5.2e4 at 64 dimensions and scale 4096) are cut to it, since squared
distances would not fit 64 bits; the dimension is that of the smallest id (of its smallest vector),
and vectors of another one stay with null code and error; a dimension that the parts do not divide
is an error; ids may repeat (each row is coded; of the rows of an id the smallest vector can start a
codebook) and be null (last in order, one id); with fewer ids than entries there are fewer entries;
null labels are one label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_MAX_BYTES, planned_bytes
from .common import materialize
from .registry import register

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SALTS = 64
SLICE = 4096


def limit(dimension: int) -> int:
    """Largest integer component: the squared distance of two vectors stays below 2 ** 62."""
    return isqrt((1 << 62) // max(1, dimension)) // 2


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of ``x`` and its squared distance, by equal-average search."""
    k, m = entries.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    s, e = sums[order], entries[order]
    own = x.sum(axis=1)
    right = np.searchsorted(s, own)
    left = right - 1
    far = np.int64((1 << 31) - 1)      # gaps beyond it cannot be told from it; its square fits
    most = np.int64((1 << 62) // m)
    best, code = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
    live = np.arange(len(x))
    while len(live):
        l, r, o = left[live], right[live], own[live]
        down = np.where(l >= 0, o - s[np.maximum(l, 0)], -1)
        up = np.where(r < k, s[np.minimum(r, k - 1)] - o, -1)
        go_up = (up >= 0) & ((down < 0) | (up < down))
        gap = np.minimum(np.where(go_up, up, down), far)
        open_ = (gap >= 0) & (gap * gap <= np.minimum(best[live], most) * m)
        live, go_up = live[open_], go_up[open_]
        at = np.where(go_up, r[open_], l[open_])
        d = ((x[live] - e[at]) ** 2).sum(axis=1)
        c = order[at]
        better = (d < best[live]) | ((d == best[live]) & (c < code[live]))
        best[live[better]], code[live[better]] = d[better], c[better]
        right[live[go_up]] += 1
        left[live[~go_up]] -= 1
    return code, best


def kept_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has finite components only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)))


def integers(col: pa.Array, dimension: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of the rows of the given dimension, and which rows those are."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(col.value_lengths().fill_null(-1))
    fits = sizes == dimension
    if not fits.all():
        col = col.filter(pa.array(fits))
    flat = np.asarray(col.flatten(), float).reshape(-1, dimension)
    top = limit(dimension)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -top, top).astype(np.int64), fits


def first_vectors(kept: DataFrame, id_col: str, vector_col: str, entries: int, scale: int) -> np.ndarray:
    """The integer vectors of the ``entries`` smallest ids (nulls last), at most that many rows."""
    ids = kept.select(id_col).distinct().orderBy(F.col(id_col).asc_nulls_last()).limit(entries)
    mine = kept.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(
        F.broadcast(ids.withColumnRenamed(id_col, "id_")), F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    rows = mine.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).collect()
    rows = [r["v"] for r in rows]
    rows = [v for v in rows if len(v) == len(rows[0])]
    if not rows or not rows[0]:
        return np.zeros((0, 0), np.int64)
    return integers(pa.array(rows, pa.list_(pa.float64())), len(rows[0]), scale)[0]


def _assigned(batches: Iterator[pa.RecordBatch], at: int, books: np.ndarray, scale: int):
    """Per slice: the rows, which of them fit, their integer parts, codes and squared distances."""
    parts, _, m = books.shape
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            rows = batch.slice(i, SLICE)
            x, fits = integers(rows.column(at), parts * m, scale)
            x = x.reshape(-1, parts, m)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            yield rows, fits, x, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks as integers, parts x entries x components; empty for a table without vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    kept = kept_vectors(df, vector_col)
    first = first_vectors(kept, id_col, vector_col, entries, scale)
    if not first.size:
        return np.zeros((0, 0, 0), np.int64)
    if first.shape[1] % parts:
        raise ValueError(f"vectors of {first.shape[1]} components cannot be cut into {parts} equal parts")
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    size, m = len(first), books.shape[2]

    def sums(batches, books):
        n, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, m), np.int64)
        for _, _, x, code, _ in _assigned(batches, 0, books, scale):
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=size)
                np.add.at(total[p], code[:, p], x[:, p])
        used = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(n.ravel()[used]),
             pa.array(list(total.reshape(-1, m)[used]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    vectors = kept.select(vector_col)
    for _ in range(rounds):
        part_sums = vectors.mapInArrow(lambda b, now=books: sums(b, now), "entry bigint, n bigint, total array<bigint>")
        rows = part_sums.groupBy("entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(m)]).alias("total")).collect()
        books = books.copy()
        for r in rows:  # at most parts x entries; integer division goes down
            books[r["entry"] // size, r["entry"] % size] = [t // r["n"] for t in r["total"]]
    return books


def encode(df: DataFrame, books: np.ndarray, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows with finite vectors: all columns but the vector, ``code`` and ``error`` (squared distance)."""
    kept = kept_vectors(df, vector_col)
    names = [c for c in kept.columns if c != vector_col and c.lower() not in ("code", "error")]
    kept = kept.select(F.col(f"`{vector_col}`"), *[F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    schema += (", " if names else "") + "code string, error bigint"
    if not books.size:
        return kept.sparkSession.createDataFrame([], schema)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for rows, fits, _, code, d in _assigned(batches, 0, books, scale):
            text, error = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            text[fits] = ["".join(x) for x in digits[code].tolist()]
            error[fits] = d.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[1:], pa.array(text, pa.string()), pa.array(error, mask=~fits)], [*names, "code", "error"])
    return kept.mapInArrow(run, schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    at = [int(code[i:i + 2], 16) for i in range(0, len(code), 2)]
    return np.concatenate([books[p, i] for p, i in enumerate(at)])


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_group_sum(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """``df`` plus the sum of ``value`` over equal ``by`` (nulls are one group). ``df`` is read twice, so
    pass a written table. Groups are summed map-side; the sums are broadcast if their written size
    allows, else joined with a salt, so that no group's rows meet in one task."""
    sums = materialize(df.groupBy(F.col(by).alias("_g")).agg(F.sum(value).alias(name)))
    if planned_bytes(sums) <= BROADCAST_MAX_BYTES:
        return df.join(F.broadcast(sums), df[by].eqNullSafe(sums["_g"]), "left").drop("_g")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)))
    copies = sums.withColumn("_salt_", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return salted.join(copies, salted[by].eqNullSafe(copies["_g"]) & (salted["_salt"] == copies["_salt_"]),
                       "left").drop("_g", "_salt", "_salt_")


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Lloyd rounds as one common table expression each; a plain search over all entries."""
    out = [f"""
with kept as materialized (
  select row_number() over () as row, vec_id, label, embedding,
         list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
dims as (select len(v) // {parts} as m from kept order by vec_id nulls last, embedding limit 1),
pieces as materialized (
  select row, p, list_slice(v, p * m + 1, p * m + m) as x from kept, dims, (select unnest(range({parts})) as p)),
firsts as (select vec_id, row_number() over (order by vec_id nulls last) - 1 as e, min(embedding) as embedding
  from kept group by vec_id order by vec_id nulls last limit {entries}),
book0 as materialized (
  select p, e, list_slice(list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)), p * m + 1, p * m + m) as c
  from firsts, dims, (select unnest(range({parts})) as p))"""]
    for i in range(rounds + 1):
        out.append(f"""
near{i} as materialized (
  select row, p, x, unnest(min_by({{'e': e, 'd': d}}, d * {entries} + e)) from (
    select row, pieces.p, x, e, cast(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
    from pieces join book{i} on pieces.p = book{i}.p) group by row, p, x)""")
        if i < rounds:
            out.append(f"""
sums{i} as (
  select p, e, k, sum(x[k + 1]) as s, count(*) as n from near{i}, dims, unnest(range(m)) as t(k) group by p, e, k),
book{i + 1} as materialized (
  select b.p, b.e, coalesce(any_value(means.c), any_value(b.c)) as c from book{i} b left join (
    select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by k) as c from sums{i} group by p, e) means
  on b.p = means.p and b.e = means.e group by b.p, b.e)""")
    out.append(f"""
coded as (
  select row, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error
  from near{rounds} group by row),
digest as (
  select sha256(string_agg(cast(c[k + 1] as varchar), ',' order by p, e, k)) as h
  from book{rounds}, dims, unnest(range(m)) as t(k))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from kept join coded using (row), digest""")
    return ",".join(out[:-1]) + "," + out[-1]


@register("op11_vector_codes", sql=_sql())
def op11_vector_codes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = train(d)
    coded = materialize(encode(d, books))
    return with_group_sum(coded, "label", F.col("error"), "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
