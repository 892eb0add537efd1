"""Approximate nearest neighbours: a trained coarse quantiser, inverted lists, multi-probe, exact re-rank.

1. ``train_centroids``: k-means on a bounded sample (the ``sample`` rows with the smallest id hashes,
   written once). A round assigns the sample in the tasks; each gives out one count and one sum
   vector per centroid that it met, Spark adds them up. A centroid that nothing is assigned to stays.
2. ``build_index``: every vector goes to the list of its nearest centroid. A list is cut into pieces of about
   ``ROWS_PER_PIECE`` rows by a hash of the id, so a list that holds a third of all vectors is many
   pieces, and (list, piece) is the unit of work.
3. ``search``: a query goes to the pieces of its ``probes`` nearest lists. Where it meets them, one matrix
   product finds the piece's ``k`` best, whose distances are taken exactly; the candidates of a query
   (at most probes x pieces x k) are ranked once more.

How many lists must be probed depends on the data. ``probes_for`` measures it: for a bounded sample of vectors
the exact neighbours are searched among all rows, and the rank of each neighbour's list among the
sampled vector's lists tells how many probes would have found it.

Only the centroids (``lists`` vectors, at most ``MAX_LISTS``) and the list sizes are broadcast. With
``probes`` = number of lists the result is that of ``knn_exact``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import materialize
from .knn import OUT_SCHEMA, _topk_block, knn_exact

MAX_LISTS = 1 << 16
SAMPLE_ROWS, ROUNDS = 50_000, 8
ROWS_PER_PIECE, ROWS_AT_ONCE = 8192, 1024
PROBES = 16
CALIBRATION, TARGET = 200, 0.95


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, the nearest first, ties by number."""
    d = (centroids ** 2).sum(axis=1)[None] - 2 * (x @ centroids.T)
    if n == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def default_lists(rows: int) -> int:
    return max(1, min(MAX_LISTS, int(rows ** 0.5)))


def _drawn(corpus: DataFrame, n: int, sample: int, id_col: str, vec: str) -> DataFrame:
    """``h, id, vec`` of the ``sample`` rows with the smallest id hashes, of ``n`` rows in all. Rows beyond twice
    the sample's share of the hashes are left out where they are read."""
    share = F.shiftrightunsigned(F.xxhash64(id_col), 1).cast("double") / float(1 << 63)
    rows = corpus.select(share.alias("h"), F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    return rows.filter(F.col("h") * n < 2 * sample + 100).orderBy("h", "id").limit(sample)


def train_centroids(corpus: DataFrame, lists: int | None = None, id_col: str = "vec_id", vec: str = "embedding",
                    sample: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, one a row. The first are the sampled vectors with the smallest hashes."""
    corpus = corpus.filter(F.col(vec).isNotNull())
    n = corpus.count()
    lists = min(lists or default_lists(n), MAX_LISTS, max(n, 1))
    drawn = materialize(_drawn(corpus, n, max(sample, lists), id_col, vec))
    first = drawn.orderBy("h", "id").limit(lists).select("vec").collect()  # at most MAX_LISTS rows
    if not first:
        return np.zeros((0, 0))
    centroids = np.array([r["vec"] for r in first], np.float64)

    def sums(batches, centroids):
        count, total = np.zeros(len(centroids)), np.zeros_like(centroids)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _matrix(batch.column(0).slice(i, ROWS_AT_ONCE))
                at = nearest_lists(x, centroids, 1)[:, 0]
                count += np.bincount(at, minlength=len(centroids))
                np.add.at(total, at, x)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]),
                                          pa.array(list(total[met]), pa.list_(pa.float64()))], ["list", "n", "total"])
    dim = centroids.shape[1]
    for _ in range(rounds):
        got = drawn.select("vec").mapInArrow(lambda b, now=centroids: sums(b, now), "list int, n double, total array<double>")
        rows = got.groupBy("list").agg(F.sum("n").alias("n"), F.array(*[
            F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")).collect()
        centroids = centroids.copy()
        for r in rows:
            centroids[r["list"]] = np.array(r["total"]) / r["n"]
    return centroids


@dataclass
class Index:
    """The pieces of all lists (``list, piece, id, vec``), the pieces per list and the centroids."""

    pieces: DataFrame
    sizes: DataFrame
    centroids: np.ndarray


def _listed(df: DataFrame, centroids: np.ndarray, n: int, id_col: str, vec: str) -> DataFrame:
    """``id, vec, lists`` of the rows that have a vector."""
    table = df.sparkSession.sparkContext.broadcast(centroids)
    kind = df.schema[id_col].dataType.simpleString()
    kind_vec = df.schema[vec].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                at = nearest_lists(_matrix(part.column(1)), table.value, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(at.astype(np.int32)), pa.list_(pa.int32()))], ["id", "vec", "lists"])
    return df.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).mapInArrow(
        run, f"id {kind}, vec {kind_vec}, lists array<int>")


def build_index(corpus: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec: str = "embedding",
                rows_per_piece: int = ROWS_PER_PIECE, path: str | None = None) -> Index:
    """Every vector of ``corpus`` in the list of its nearest centroid, written (to ``path`` or the shared
    checkpoint folder)."""
    listed = _listed(corpus, centroids, 1, id_col, vec).select("id", "vec", F.col("lists")[0].alias("list"))
    if path:
        listed.write.mode("overwrite").parquet(path)
        listed = corpus.sparkSession.read.parquet(path)
    else:
        listed = materialize(listed)
    sizes = materialize(listed.groupBy("list").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_piece).cast("int").alias("pieces")))  # one row per list
    pieces = listed.join(F.broadcast(sizes), "list").withColumn(
        "piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    return Index(pieces, sizes, centroids)


def search(queries: DataFrame, index: Index, k: int, probes: int = PROBES, id_col: str = "vec_id",
           vec: str = "embedding", nn: str = "nn_vec_id", exclude_self: bool = False) -> DataFrame:
    """``(id_col, rank, nn, dist)``: of each query the k nearest vectors among those of its ``probes`` nearest lists."""
    probes = min(probes, len(index.centroids))
    if not probes:
        return queries.sparkSession.createDataFrame([], f"{id_col} bigint, rank bigint, {nn} bigint, dist double")
    q = _listed(queries, index.centroids, probes, id_col, vec).select("id", "vec", F.explode("lists").alias("list"))
    q = q.join(F.broadcast(index.sizes), "list").select(
        "id", "vec", "list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    best = q.groupBy("list", "piece").cogroup(index.pieces.groupBy("list", "piece")).applyInPandas(
        _topk_block(k, exclude_self), OUT_SCHEMA)
    w = Window.partitionBy("qid").orderBy("dist", "cid")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(id_col), F.col("rank").cast("bigint").alias("rank"), F.col("cid").alias(nn), "dist")


def probes_for(corpus: DataFrame, index: Index, k: int, target: float = TARGET, sample: int = CALIBRATION,
               id_col: str = "vec_id", vec: str = "embedding") -> int:
    """The least number of probes that finds ``target`` of the k nearest of the sampled vectors."""
    corpus = corpus.filter(F.col(vec).isNotNull())
    drawn = materialize(_drawn(corpus, corpus.count(), sample, id_col, vec).select("id", "vec"))
    rows = corpus.select(F.col(id_col).alias("nn"), F.col(vec).alias("vec"))
    exact = knn_exact(drawn, rows, k, qid="id", cid="nn", vec="vec", exclude_self=True)
    pairs = index.pieces.select(F.col("id").alias("nn"), "list").join(
        F.broadcast(exact.select("id", "nn")), "nn").select("id", "list").collect()  # sample x k rows
    vectors = {r["id"]: r["vec"] for r in drawn.collect()}
    if not pairs:
        return 1
    order = {i: np.argsort(nearest_lists(np.array([v], np.float64), index.centroids, len(index.centroids))[0])
             for i, v in vectors.items()}  # the place of each list
    need = np.sort([order[r["id"]][r["list"]] + 1 for r in pairs])
    return int(need[int(np.ceil(target * len(need))) - 1])


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id", nn: str = "nn_vec_id") -> DataFrame:
    """Per query: neighbours of ``exact`` and how many of them ``found`` has."""
    hit = found.select(id_col, nn, F.lit(1).alias("_hit"))
    return exact.join(hit, [id_col, nn], "left").groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("_hit").alias("n_found"))
