"""Inverted-list index: recall against exact search, hot lists, awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from turnwise.operators import ivf, knn
from turnwise.plans import registry


def _exact(q, e, k):
    return knn.knn_exact(q, e, k, qid="vec_id", cid="vec_id", vec="embedding", exclude_self=True)


@pytest.mark.parametrize("folder", [SF_CHECK, SF_CHECK.replace("sf0.01", "sf0.1")])
def test_recall_of_the_stated_query_set(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    q, k = e.filter("vec_id % 20 = 0"), 10
    index = ivf.build_index(e, ivf.train_centroids(e))
    probes = ivf.probes_for(e, index, k)
    r = ivf.recall(ivf.search(q, index, k, probes, exclude_self=True), _exact(q, e, k)).agg(
        F.sum("n_found") / F.sum("n_exact"), F.count("*")).head()
    assert r[0] >= 0.9 and r[1] == q.count()
    assert probes <= len(index.centroids)


def test_registered_query_recall(spark):
    q = registry.queries()
    found = q["knn_approx"](spark, SF_CHECK)
    exact = q["knn_topk"](spark, SF_CHECK)
    r = ivf.recall(found, exact).agg(F.sum("n_found") / F.sum("n_exact")).head()[0]
    assert r >= 0.9 and sorted(found.columns) == sorted(exact.columns)


def _clustered(spark, n=3000, dim=12, hot=1000):
    """Clusters apart from each other; a third of all vectors in one of them, some equal."""
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 10, (20, dim))
    rows = [(i, (centre[0 if i < hot else i % 20] + rng.normal(0, 0.5, dim)).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(20)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_few_probes_are_enough_for_clusters_and_hot_lists_are_split(spark):
    e = _clustered(spark)
    index = ivf.build_index(e, ivf.train_centroids(e, lists=20), rows_per_piece=100)
    largest = index.pieces.groupBy("list", "piece").count().agg(F.max("count")).head()[0]
    assert index.sizes.agg(F.max("pieces")).head()[0] >= 3 and largest < 200
    q = e.filter("vec_id % 20 = 0")
    probes = ivf.probes_for(e, index, 5, target=0.99)
    assert probes <= 10
    r = ivf.recall(ivf.search(q, index, 5, probes, exclude_self=True), _exact(q, e, 5)).agg(F.sum("n_found") / F.sum("n_exact"))
    assert r.head()[0] > 0.95


def test_all_probes_are_exact_search(spark):
    e = _clustered(spark, 400, 6, 100)
    index = ivf.build_index(e, ivf.train_centroids(e, lists=9, rounds=3), rows_per_piece=50)
    q = e.filter("vec_id % 7 = 0")
    got = ivf.search(q, index, 4, probes=99, exclude_self=True).collect()
    want = _exact(q, e, 4).select("vec_id", "rank", "nn_vec_id", "dist").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((r[0], r[1], r[2]) for r in want)


def test_centroids_against_a_plain_loop(spark):
    e = _clustered(spark, 200, 4, 60)
    rows = e.withColumn("h", F.shiftrightunsigned(F.xxhash64("vec_id"), 1)).orderBy("h", "vec_id").collect()
    x = np.array([r["embedding"] for r in rows])
    c = x[:6].copy()
    for _ in range(4):
        at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(6)])
    assert np.allclose(ivf.train_centroids(e, lists=6, rounds=4), c)


def test_null_vectors_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(30)] + [(99, None)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = ivf.build_index(e, ivf.train_centroids(e))
    got = ivf.search(e, index, 2, exclude_self=True).collect()
    assert len(got) == 60 and all(99 not in (r["vec_id"], r["nn_vec_id"]) for r in got)
    none = e.limit(0)
    empty = ivf.build_index(none, ivf.train_centroids(none))
    assert ivf.search(e, empty, 2).collect() == [] and ivf.search(none, index, 2).collect() == []
    assert ivf.probes_for(none, index, 2) == 1
