"""Exact and near duplicates against brute force."""

import random
import re

import numpy as np
import xxhash

from tests.conftest import SF_SMALL
from turnwise.llm import exact_dedup, simhash
from turnwise.llm.common import documents

from .cases import edge_docs, sentence


def test_exact_dedup_keeps_one_whole_row_of_each_text(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or ""), []).append(r)
    want = {t: min((r["doc_id"] for r in rs if r["doc_id"] is not None), default=None) for t, rs in groups.items()}
    got = {re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or ""): r["doc_id"] for r in kept.collect()}
    assert got == want and kept.count() == len(want)


def test_heavy_groups_are_settled_before_the_shuffle(spark):
    rows = [(i, "same  text" if i % 2 else f"text {i}") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    digests = d.select("doc_id", exact_dedup.text_digest(d["text"]).alias("text_sha256"))
    heavy = exact_dedup.heavy_groups(digests, "doc_id").collect()
    assert [(r["_heavy_id"], r["_heavy_size"]) for r in heavy] == [(1, 2000)]
    out = {r["doc_id"]: r for r in exact_dedup.exact_dedup(d).collect()}
    assert all(out[i]["kept"] == (i % 2 == 0 or i == 1) for i in range(4000))
    assert out[3999]["keep_id"] == 1 and out[3999]["group_size"] == 2000 and out[2]["group_size"] == 1


def slow_simhash(text, shingle=3):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, bits=3):
    """Smallest id reachable over links, by comparing every two."""
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def _check(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_simhash(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], fps, slow_components([r["doc_id"] for r in rows], fps)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])
                  for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_simhash_against_brute_force(spark):
    _check(documents(spark, SF_SMALL))


def test_simhash_awkward_rows(spark):
    _check(edge_docs(spark))


def test_simhash_near_copies(spark):
    rng, rows = random.Random(5), []
    for g in range(6):
        words = sentence(g, 150).split()
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    _check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_links_find_every_pair_at_three_bits(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for x in base[:100]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = slow_components([signed(x) for x in fps], fps)
    assert [roots.get(x, signed(x)) for x in fps] == want


def test_large_anchor_is_divided_without_loss(monkeypatch):
    rng = random.Random(3)
    fps = np.unique(np.array([0xABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9)))
                              for _ in range(300)], np.uint64))

    def partition():
        forest = simhash.Forest()
        for a, b in simhash._group_links(fps, 3):
            for x, y in zip(a.tolist(), b.tolist()):
                assert (x ^ y).bit_count() <= 3
                forest.join(x, y)
        return [forest.root(x) for x in fps.tolist()]
    plain = partition()
    monkeypatch.setattr(simhash, "WALK", 10)
    assert partition() == plain
    assert plain == slow_components(fps.tolist(), fps.tolist())


def _clustered(rng, n, near):
    """``n`` fingerprints that share their lower half up to a bit; the first ``near`` of them in chains of links."""
    fps = {rng.getrandbits(32) << 32 | 0x1234567 for _ in range(n - 3 * near)}
    for x in sorted(fps)[:near]:
        for _ in range(3):
            for b in rng.sample(range(64) if rng.random() < 0.5 else range(32, 64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    return np.array(sorted(fps), np.uint64)


def test_hot_anchors_are_dealt_without_loss(spark, monkeypatch):
    fps = _clustered(random.Random(8), 1500, 200)
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp bigint")
    monkeypatch.setattr(simhash, "HOT_ANCHOR", 100)
    monkeypatch.setattr(simhash, "WALK", 20)
    monkeypatch.setattr(simhash, "HEAVY", 20)
    assert simhash.dealt_replicas(df).count() > simhash.replicas(df).count()
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    signed = fps.view(np.int64).tolist()
    assert [roots.get(x, x) for x in signed] == slow_components(signed, fps.tolist())


def test_very_hot_half_is_many_tasks(spark):
    """200,000 fingerprints that share a half: no group comes near that, and links equal brute force on a part."""
    rng = random.Random(4)
    fps = _clustered(rng, 200_000, 500)
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp bigint").repartition(8)
    largest = simhash.dealt_replicas(df).groupBy("deal").count().agg({"count": "max"}).head()[0]
    assert largest < len(fps) / 50
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    for x in [*fps[:150], *fps[rng.randrange(len(fps)):][:150]]:
        near = fps[np.bitwise_count(fps ^ x) <= 3].view(np.int64).tolist()
        assert len({roots.get(y, y) for y in near}) == 1


def test_every_word_has_its_anchors_within_two_bits(spark):
    masks = simhash._flip_masks()
    assert all(len(m) == (16 if s else 1) and max(x.bit_count() for x in m) <= 2 for s, m in enumerate(masks))
    df = spark.createDataFrame([(x,) for x in (0, 1, 5, -1, 123456789012345)], "fp bigint")
    found = simhash.replicas(df).collect()
    for r in found:
        word = r["fp"] % (1 << 64) >> (32 if r["anchor"] >> 31 else 0) & (1 << 31) - 1
        anchor = r["anchor"] & (1 << 31) - 1
        assert (word ^ anchor).bit_count() <= 2
        s = 0
        for i in range(1, 32):
            s ^= i if anchor >> (i - 1) & 1 else 0
        assert s == 0


def test_one_document_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    named = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert named == sorted({r["component_id"] for r in found if r["doc_id"] is not None})
