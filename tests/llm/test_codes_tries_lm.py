"""Vector codes, prefix trie and PPM scores against brute force, on awkward tables and at hot keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from turnwise import llm
from turnwise.llm import ppm, prefix_trie, vector_codes
from turnwise.llm.common import documents

from .cases import edge_docs, empty_docs

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, code string, `Error` bigint, `_g` int"


def vector_rows(n=300, dim=16):
    rng = random.Random(5)
    rows = [(i * 7 % 1009, [rng.uniform(-1, 1) for _ in range(dim)], i % 3 if i % 5 else None, "c", 1, 2) for i in range(n)]
    rows += [rows[3], rows[4]]                                             # repeated rows
    rows += [(rows[5][0], [0.25] * dim, 1, None, None, None)]              # an id with two vectors
    rows += [(None, [0.5] * dim, 2, None, None, None)]
    rows += [(5000, None, 1, None, None, None), (5001, [None] * dim, 1, None, None, None),
             (5002, [NAN] * dim, 1, None, None, None), (5003, [INF] + [0.0] * (dim - 1), 1, None, None, None)]
    rows += [(6000 + i, [0.125] * dim, 0, None, None, None) for i in range(100)]  # a group of copies, all ties
    return rows


def duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    res = con.execute(sql)
    return [d[0] for d in res.description], res.fetchall()


def same_as_sql(spark, key, table, df, tmp_path):
    df.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    out = llm.queries()[key](spark, str(tmp_path))
    cols, want = duck(llm.oracle_sql()[key], **{table: f"{tmp_path}/{table}.parquet/*.parquet"})
    assert sorted(cols) == sorted(out.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in out.collect()))) == sorted(map(str, want))
    return out


def test_nearest_finds_the_lowest_index_among_the_nearest():
    rng = np.random.default_rng(3)
    for top in (3, 50, vector_codes.limit(32)):
        x, e = rng.integers(-top, top + 1, (400, 4)), rng.integers(-top, top + 1, (16, 4))
        e[9] = e[2]
        d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        code, best = vector_codes.nearest(x, e)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_vector_codes_on_an_awkward_table(spark, tmp_path):
    d = spark.createDataFrame(vector_rows(), VECTORS)
    same_as_sql(spark, "op11_vector_codes", "embeddings", d, tmp_path)


def test_vector_codes_few_vectors_other_dimensions_and_large_components(spark):
    d = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, -1e30]), (3, [1.0]), (4, [])], "vec_id int, embedding array<double>")
    books = vector_codes.train(d, parts=2, rounds=1)
    assert books.shape == (2, 2, 1) and books[0].ravel().tolist() == [3 * 4096, 4096]
    rows = {r["vec_id"]: r for r in vector_codes.encode(d, books).collect()}
    assert rows[1]["code"] == "0000" and rows[2]["code"] == "0101" and rows[3]["code"] is None and rows[4]["error"] is None
    assert books[1, 0, 0] == -vector_codes.limit(2)
    assert (vector_codes.decode("0100", books) == [4096, -vector_codes.limit(2)]).all()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.train(d, parts=3)


def test_group_sums_are_alike_broadcast_or_salted(spark, monkeypatch):
    d = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, i) for i in range(90)], "id int, label int, v bigint")
    want = sorted(map(str, vector_codes.with_group_sum(d, "label", d["v"], "total").collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_MAX_BYTES", -1)
    assert sorted(map(str, vector_codes.with_group_sum(d, "label", d["v"], "total").collect())) == want


TURNS = "conv_id bigint, turn bigint, role string, text string, sid int, `Path` string"


def conversation_rows():
    rng = random.Random(9)
    rows = []
    for c in range(120):
        for t in range(rng.choice([0, 1, 3, 6, 9, 12])):
            rows.append((c, t, "user" if t % 2 else "bot", f"t{rng.randrange(2)}" if t < 3 else f"é{rng.randrange(3)}"))
    rows += [(200 + i, 0, "user", "hello") for i in range(60)]             # copies
    rows += [(400 + 5 * i, t, "user", f"long {t}") for i in range(12) for t in range(40)]
    rows += [(7, None, None, None), (7, None, "x", "tie"), (8, 1, None, "tie"), (-3, 0, "user", "hello"), (-5, 0, None, None),
             (None, 0, "user", "hello"), (9, 2, "user", "same"), (9, 2, "user", "same"), (301, 0, "user", "alone")]
    return [(*r, 0, "p") for r in rows]


def test_prefix_trie_on_an_awkward_table(spark, tmp_path):
    same_as_sql(spark, "op12_prefix_trie", "conversations", spark.createDataFrame(conversation_rows(), TURNS), tmp_path)


def slow_trie(convs):
    """Every prefix as a key of a dictionary."""
    members = defaultdict(list)
    for c, path in convs:
        for d in range(len(path) // 24 + 1):
            members[path[:24 * d]].append(c)
    ends, kids = defaultdict(list), Counter(p[:-24] for p in members if p)
    for c, path in convs:
        ends[path].append(c)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        gain = (len(cs) - 1) * int.from_bytes(p[-8:], "big") if p else 0
        for d in range(len(p) // 24 + 1):
            leaves[p[:24 * d]] += not kids[p]
            saved[p[:24 * d]] += gain
    return sorted((min(cs), len(p) // 24, min(members[p[:-24]]) if p else -1, len(cs), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, cs in members.items())


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_prefix_trie_at_any_number_of_shards(spark, shards, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)  # ends of a node in many chunks
    rng = random.Random(shards)
    block = lambda i: hashlib.sha256(str(i).encode()).digest()[:16] + (i % 50).to_bytes(8, "big")
    convs = [(i, b"".join(block(rng.randrange(2) + 10 * d) for d in range(rng.randrange(7)))) for i in range(150)]
    hot = b"".join(block(d) for d in range(5))
    convs += [(1000 + i, hot) for i in range(150)]  # half of all conversations are copies
    got = prefix_trie.trie(spark.createDataFrame(convs, "conv_id bigint, path binary"), shards).collect()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == slow_trie(convs)
    few = prefix_trie.trie(spark.createDataFrame(convs, "conv_id bigint, path binary"), shards, most=3).collect()
    assert sorted(map(str, few)) == sorted(map(str, got))  # a skeleton beyond its bound: fewer shards


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    for key in ("op11_vector_codes", "op12_prefix_trie"):
        out = llm.queries()[key](spark, str(tmp_path))
        assert out.collect() == [] and sorted(out.columns) == sorted(duck(
            llm.oracle_sql()[key], embeddings=f"{SF_SMALL}/embeddings.parquet",
            conversations=f"{SF_SMALL}/conversations.parquet")[0])
    assert ppm.score(empty_docs(spark)).collect() == []


def slow_ppm(rows, order):
    """Plain PPM with method C and exclusion, a symbol at a time."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", lower(t)) if w] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    after, known = defaultdict(Counter), Counter()
    for i, t in rows:
        if not held(i):
            s = [256] * order + list(lower(t).encode()) + [256]
            for p in range(order, len(s)):
                for k in range(order + 1):
                    after[tuple(s[p - k:p])][s[p]] += 1
            known.update(split(t))
    total, distinct = sum(known.values()), len(known)
    out = []
    for i, t in rows:
        s = [256] * order + list(lower(t).encode()) + [256]
        score = 0.0
        for p in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                left = {x: n for x, n in after.get(tuple(s[p - k:p]), {}).items() if x not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if s[p] in left:
                    score += math.log10(left[s[p]] / whole)
                    break
                score += math.log10(len(left) / whole)
                gone |= set(left)
            else:
                score -= math.log10(257 - len(gone))
        w = split(t)
        out.append((i, held(i), len(w), sum(known[x] > 0 for x in w), total, sum(
            math.log10((known[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), score))
    return out


def _same_scores(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[2], r[5]))
    for a, b in zip(order(map(tuple, got)), order(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [0, 1, 4, 6])
def test_ppm_equals_a_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 400)  # many blocks
    monkeypatch.setattr(ppm, "SLICE", 150)
    rows = [(i, t) for i, t in enumerate(["", None, "a", "The THE the", "ab\tAB \n", "é漢字 😀", "x" * 300] * 3)]
    rows += [(100 + i, " ".join(random.Random(i).choices(["the", "cat", "sat", "Ünder"], k=i))) for i in range(40)]
    rows += [rows[3], (None, "unseen ~~ words"), (None, None)]
    d = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id bigint, text string, score double, `Key` int")
    for head in (ppm.HEAD, 40, 0):  # all, some and none of the pairs are broadcast
        _same_scores(ppm.score(d.repartition(3), order=order, head=head).collect(), slow_ppm(rows, order))


def test_ppm_awkward_table(spark):
    d = edge_docs(spark)
    _same_scores(ppm.score(d, order=3).collect(), slow_ppm([(r["doc_id"], r["text"]) for r in d.collect()], 3))


def test_ppm_without_training_texts(spark):
    rows = [(i, "abc") for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = ppm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    _same_scores(got, slow_ppm(rows, ppm.ORDER))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_ppm_probabilities_of_a_context_sum_to_one(spark):
    """All 257 symbols after one context, most of them never seen there."""
    text = "abracadabra abrupt cadaver"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    seen = {r["key"]: r["n"] for r in ppm.wanted(ppm.blocks(d), 2).filter("key >= 0").collect()}
    for context in (b"ab", b"ra", b"zz", b" a"):
        head = (context[0] << 18) | (context[1] << 9)
        table = dict(seen) | {head | x: seen.get(head | x, 0) for x in range(257)}
        counts = spark.createDataFrame(list(table.items()), "key bigint, n bigint")
        got = {r["key"]: r["value"] for r in ppm.code_lengths(counts, 2).collect()}
        assert sum(10 ** got[head | x] for x in range(257)) == pytest.approx(1.0)


def test_ppm_tells_texts_of_the_language_from_others(spark):
    """Bits a byte: far below 8 on held-out texts, and the same bytes in another order cost more."""
    d = documents(spark, SF_SMALL).select("doc_id", "text").filter("length(text) > 500")
    held = ppm.held_out(F.col("doc_id"))
    turned = d.filter(held).select((F.col("doc_id") + 10**9).alias("doc_id"), F.reverse("text").alias("text"))
    both = ppm.score(d.unionByName(turned.filter(ppm.held_out(F.col("doc_id"))))).filter("held_out")
    own = both.filter("doc_id < 1000000000").agg({"score": "sum"}).head()[0]
    size = d.filter(held).agg(F.sum(F.octet_length("text"))).head()[0]
    assert -own / math.log10(2) / size < 4
    other = both.filter("doc_id >= 1000000000").join(
        d.select((F.col("doc_id") + 10**9).alias("doc_id"), F.col("text")), "doc_id")
    cost = other.agg(F.sum("score"), F.sum(F.octet_length("text"))).head()
    if cost[1]:
        assert -cost[0] / cost[1] > -own / size
