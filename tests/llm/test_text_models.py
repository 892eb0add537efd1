"""BPE, language identification, quality, mixing, fingerprints and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_CHECK, SF_SMALL
from turnwise.llm import bpe_codec, bytehash, exact_dedup, fingerprints, language_id, mixing, quality, simhash
from turnwise.llm.common import documents, labels

from .cases import edge_docs, edge_rows, sentence
from .test_dedup import slow_components, slow_simhash

WEIRD = ["", " ", "a", "don't  we'll\n\n x", "<|endoftext|><|endoftext|> a<|endoft ext|>", " 　 x​ ", "é" * 3000,
         " " * 3000, "x" * 3000, "\r\n\t" * 500, "😀👨‍👩‍👧 漢字 العربية हिन्दी", "1234567890 " * 400, "a,b.c;d " * 500, "naïve — “quoted”…"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe_codec.default_vocabulary())


def _same_as_library(spark, tokenizer, texts, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: r for r in bpe_codec.decode(bpe_codec.encode(d, **kw)).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want, (i, (t or "")[:50])
        assert got[i]["text"] == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_on_weird_texts(spark, tokenizer):
    _same_as_library(spark, tokenizer, WEIRD + [None] + [r[1] for r in edge_rows()])


@pytest.mark.parametrize("unit", [" ", "\n", " \n\t", "\xa0", "a", "7", "!", "漢"])
def test_bpe_of_runs_of_two_million_characters(tokenizer, unit):
    c = bpe_codec.codec(bpe_codec.default_vocabulary())
    run = (unit * 2_000_000)[:2_000_000]
    for text in ("a b" + run + "x", "a" + run + "<|endoftext|>" + run[:20_000]):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.array_equal(np.frombuffer(c.ids(text.encode()), "<u4"), want)


def test_bpe_of_long_runs_in_documents(spark, tokenizer):
    _same_as_library(spark, tokenizer, [" " * 1_200_000 + "x", sentence(1, 50) + "\n" * 30_000, "\t" * 10_000 + " 's"])


def test_bpe_with_shared_passages(spark, tokenizer):
    rng = random.Random(4)
    shared = [sentence(s, 400) for s in range(4)] + ["x" * 2500, "<|endoftext|>" * 150, ("né  " * 700)]
    texts = ["".join(rng.choice([sentence(rng.randrange(10**6), 5), " ", "", "'", "\n\n"]) + rng.choice(shared)[rng.randrange(60):]
                     for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    assert len(bpe_codec.shared_digests(d)) > 5
    _same_as_library(spark, tokenizer, texts)
    _same_as_library(spark, tokenizer, texts, most=3)


def test_bpe_repairs_joins_and_gives_chunks_up():
    c = bpe_codec.codec(bpe_codec.default_vocabulary())
    text = sentence(9, 300).encode()
    x = bpe_codec.encode_chunk(text[100:900], c)
    assert bpe_codec.assemble(text, [(100, x)], c) == c.ids(text)
    wrong_tail = x._replace(tail_ids=b"abcd")
    wrong_head = x._replace(head_ids=b"abcd")
    y = bpe_codec.encode_chunk(text[1000:1800], c)
    for found in ([(100, wrong_tail)], [(100, wrong_head)], [(100, wrong_tail), (1000, y)],
                  [(100, x), (1000, y._replace(head_ids=b"abcd"))], [(100, x), (1000, y._replace(tail_ids=b"abcd"))]):
        assert bpe_codec.assemble(text, found, c) == c.ids(text)


def test_language_of_held_out_documents(spark):
    d = documents(spark, SF_CHECK)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.train(d.filter(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    got = language_id.predict(d.filter(held), model).join(d, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .,"), (4, "der"), (4, "der")], "doc_id bigint, text string")
    rows = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect())
    assert rows[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert rows[3][1] == rows[4][1] and abs(rows[3][2] - rows[4][2]) < 1e-4


def test_language_gradients_and_windows():
    model = language_id.ByteCNN(["a", "b"], seed=1)
    rng = np.random.default_rng(0)
    x = rng.integers(1, 255, (6, language_id.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0])
    for k in model.weights:
        model.weights[k] = model.weights[k].astype(np.float64)
    loss = lambda: -model.log_probabilities(x)[np.arange(6), y].mean()
    grads = model._gradients(x, y, np.ones(6))
    for k, at in (("dense", (3, 1)), ("filters", (2, 5)), ("filter_bias", (7,)), ("embedding", (int(x[0, 9]), 2))):
        eps, w = 1e-5, model.weights[k]
        w[at] += eps
        up = loss()
        w[at] -= 2 * eps
        assert abs((up - loss()) / (2 * eps) - grads[k][at]) < 1e-4
        w[at] += eps
    texts = [b"", b"abc", b"x" * 256, b"y" * 600]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    w, row, held = language_id.windows(data, off)
    assert row.tolist() == [0, 1, 2, 3, 3, 3] and held.tolist() == [0, 3, 256, 256, 256, 88]
    assert bytes(w[5][:88]) == b"y" * 88 and not w[5][88:].any()


def test_network_against_plain_loops():
    """Every filter at every place of a window, one multiplication at a time."""
    model = language_id.ByteCNN(["a", "b", "c"], seed=3)
    texts = [b"Der Hund", b"", b"x" * 300, "é漢字 text".encode()]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    x, _, _ = language_id.windows(data, off)
    w, got = model.weights, model.log_probabilities(x)
    for window, row in zip(x, got):
        hidden = []
        for f in range(len(w["filter_bias"])):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            best = max(sum(float(w["embedding"][window[at + k], e] * w["filters"][k * language_id.EMBEDDING + e, f])
                           for k in range(width) for e in range(language_id.EMBEDDING))
                       for at in range(0, language_id.WINDOW - max(language_id.WIDTHS) + 1, language_id.STRIDE))
            hidden.append(max(0.0, best + float(w["filter_bias"][f])))
        z = [sum(h * float(w["dense"][i, c]) for i, h in enumerate(hidden)) + float(w["dense_bias"][c]) for c in range(3)]
        whole = np.log(sum(np.exp(z)))
        assert np.allclose(row, [v - whole for v in z], atol=1e-4)


def test_language_scores_of_texts_are_means_over_windows(spark):
    model = language_id.ByteCNN(["a", "b"], seed=5)
    texts = ["short é", sentence(1, 200), "x" * 256]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in language_id.predict(d, model).collect():
        raw = texts[r["doc_id"]].encode()
        total = np.zeros(2)
        for i in range(0, len(raw), language_id.WINDOW):
            part = raw[i:i + language_id.WINDOW]
            total += model.log_probabilities(np.frombuffer(part.ljust(language_id.WINDOW, b"\0"), np.uint8)[None])[0] * len(part)
        p = np.exp(total / len(raw)) / np.exp(total / len(raw)).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4


def test_one_id_repeated_many_times(spark, monkeypatch):
    """Languages, sides and domains whose rows mostly share an id are learnt, from bounded samples."""
    german = "der Hund läuft über die Straße und die Katze schläft"
    rows = [(i, sentence(i, 40), "en") for i in range(600)] + [(9999, german, "de")] * 5000
    rows += [(None, german + " heute", "de")] * 50
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language_id.train(d)
    assert model.languages == ["de", "en"]
    pred = language_id.predict(spark.createDataFrame([(1, german), (2, sentence(5000, 40))], "doc_id bigint, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in pred.collect()} == {1: "de", 2: "en"}
    junk = "$$$$ #### ==== @@@@ ~~~~ ||||"
    rows = [(i, sentence(i, 60)) for i in range(300)] + [(9999, junk)] * 5000 + [(9998, sentence(1, 60)), (9998, junk)] * 400
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sizes = []
    fit = quality.Scorer.fit
    monkeypatch.setattr(quality.Scorer, "fit", lambda self, x, y: sizes.append(len(x)) or fit(self, x, y))
    model = quality.train(d)
    assert sizes[0] <= 302
    kept = {(r["doc_id"], r["kept"]) for r in quality.score(d, model).filter("doc_id in (5, 9999)").collect()}
    assert kept == {(5, True), (9999, False)}
    named = spark.createDataFrame([(i, "clean") for i in range(300)] + [(9999, "junk")] * 300 + [(9998, "clean")] * 300,
                                  "doc_id bigint, domain string")
    seen = []
    fit_words = mixing._fit
    monkeypatch.setattr(mixing, "_fit", lambda x, y, k: seen.append(len(x)) or fit_words(x, y, k))
    assert mixing.train(d, named).domains == ["clean", "junk"] and seen == [302]


def test_samples_of_groups_beyond_the_broadcast(spark, monkeypatch):
    from turnwise.llm import common
    monkeypatch.setattr(common, "MAX_GROUPS", 2)
    d = spark.createDataFrame([(i, i % 5, f"t{i}") for i in range(1000)] * 2, "id bigint, g int, t string")
    got = common.smallest_hashes(d, "g", F.xxhash64("id"), 7).collect()
    want = {}
    for i, h in sorted(d.select("id", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h")).distinct().collect(), key=lambda r: r["h"]):
        want.setdefault(i % 5, []).append(i)
    assert {(r["g"], r["id"], r["at"]) for r in got} == {(g, i, k + 1) for g, ids in want.items() for k, i in enumerate(ids[:7])}


def slow_quality(texts):
    """Votes, EM over single rows and features by plain loops: posteriors and feature rows."""
    good_rate = lambda x, n: x / max(n, 1)
    votes, feats = [], []
    for t in texts:
        raw = t.encode()
        ws = raw.split()
        letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
        inked, n = sum(map(len, ws)), len(ws)
        s = [good_rate(sum(chr(b) in "#$%&*+/<=>@[\\]^_`{|}~" for b in raw), inked),
             good_rate(sum(map(letter, raw)), inked), good_rate(sum(a == b for a, b in zip(ws, ws[1:])), n),
             len(set(ws)) / max(n, 1) ** 0.5, good_rate(sum(w[-1:] in (b".", b"!", b"?") for w in ws), n),
             good_rate(sum(not any(map(letter, w)) for w in ws), n), good_rate(sum(len(w) <= 3 for w in ws), n),
             good_rate(inked, n)]
        some, many = n >= 5, n >= 15
        rules = [(some and s[0] < 0.02, some and s[0] > 0.08), (some and s[1] > 0.90, some and s[1] < 0.80),
                 (many and s[2] < 0.04, many and s[2] > 0.20), (many and s[3] > 2.2, many and s[3] < 1.8),
                 (many and 0.02 < s[4] < 0.4, many and s[4] < 0.01), (some and s[5] < 0.05, some and s[5] > 0.20),
                 (many and s[6] > 0.15 and s[7] < 12, many and (s[6] < 0.03 or s[7] > 25))]
        votes.append([2 if bad else 1 if good else 0 for good, bad in rules])
        f = np.zeros(quality.BUCKETS)
        for a, b in zip(raw, raw[1:]):
            f[((a << 8 | b) * 0x9E3779B1 % 2**32) >> 20] += 20 / len(raw)
        for k, (x, scale) in enumerate(zip(s, [0.02, 0.03, 0.05, 0.4, 0.03, 0.05, 0.08, 2.0])):
            name = bytehash.mix(np.array([k * 1000 + int(min(x / scale, quality.STEPS - 1))], np.uint64))
            f[int(name[0] % np.uint64(quality.BUCKETS))] += 0.5
        feats.append(f)
    up = [(v.count(1), v.count(2)) for v in votes]
    good = [(a + 1) / (a + 2 * b + 2) if a + b else 0.5 for a, b in up]
    for _ in range(quality.EM_ROUNDS):
        weigh = [[(1 - g), g] for g in good]
        mass = [sum(w[c] for w, (a, b) in zip(weigh, up) if a + b) for c in (0, 1)]
        prior = [(m + 1) / (sum(mass) + 2) for m in mass]
        rate = []
        for j in range(7):
            each = [[sum(w[c] for w, v in zip(weigh, votes) if v[j] == x) + 0.5 for x in (1, 2)] for c in (0, 1)]
            rate.append([[1.0, *(y / sum(z) for y in z)] for z in each])
        odds = []
        for v in votes:
            l0, l1 = (np.log(prior[c]) + sum(np.log(rate[j][c][v[j]]) for j in range(7)) for c in (0, 1))
            odds.append(1 / (1 + np.exp(np.clip(l0 - l1, -500, 500))))
        good = odds
    return good, feats


def test_quality_against_plain_loops(spark):
    d = documents(spark, SF_SMALL).filter("length(text) < 4000")
    rows = {r["doc_id"]: r["text"] for r in d.collect() if (r["text"] or "").split()}
    model = quality.train(d)
    got = {r["doc_id"]: r for r in quality.score(d, model).collect()}
    good, feats = slow_quality(list(rows.values()))
    for i, g, f in zip(rows, good, feats):
        assert got[i]["weak_label"] == pytest.approx(g, abs=1e-9)
        z = float(sum(a * b for a, b in zip(f, model[0].w.tolist()) if a)) + model[0].b
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -60, 60))), abs=1e-3)


def test_quality_keeps_clean_and_rejects_junk(spark):
    d = documents(spark, SF_CHECK)
    rows = quality.score(d, quality.train(d)).join(labels(spark, SF_CHECK), "doc_id").collect()
    kept = lambda q: np.mean([r["kept"] for r in rows if r["quality"] == q])
    assert kept(1) > 0.97 and kept(0) < 0.05
    assert all((r["score"] >= quality.THRESHOLD) == r["kept"] for r in rows)


def test_quality_statistics_by_hand():
    texts = [b"", b"a a b $$ .", b"\n x", "é é 12".encode()]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    s, n = quality.statistics(data, off)
    s = {k: v for k, v in zip(quality.STATISTICS, s.T)}
    assert n.tolist() == [0, 5, 1, 3]
    assert s["repeats"].tolist() == [0, 0.2, 0, 1 / 3] and s["wordless"].tolist() == [0, 0.4, 0, 1 / 3]
    assert s["symbols"][1] == 2 / 6 and s["letters"][3] == 4 / 6 and s["stops"][1] == 0.2


def test_em_recovers_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = [0.9, 0.85, 0.8, 0.9, 0.7, 0.95, 0.75]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < p) == truth, 1, 2))
                      for p in right], axis=1)
    patterns, at, counts = np.unique(quality._pattern(votes), return_inverse=True, return_counts=True)
    good, rate = quality.estimate(patterns, counts.astype(float))
    assert np.mean((good[at] >= 0.5) == truth) > 0.95
    assert np.allclose(rate[:, 1, 1], right, atol=0.03)


def test_quality_filter_carries_all_columns(spark):
    docs = edge_docs(spark)
    model = quality.train(docs)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    want = sorted((r["doc_id"] for r in quality.score(docs, model).collect() if r["kept"]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def test_mixing_meets_targets(spark):
    d = documents(spark, SF_CHECK)
    named = labels(spark, SF_CHECK).select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    model, steps, member = mixing.plan(d, named)
    rows = mixing.with_rates(member, steps).collect()
    p, n = np.array([r["p"] for r in rows]), np.array([r["n_words"] for r in rows], float)
    r = np.array([x["rate"] for x in rows])
    # the same problem by plain loops over the rows
    slow = np.ones(len(rows))
    for g in steps:
        slow = [min(1.0, max(0.0, x - sum(a * b for a, b in zip(q, g)))) for x, q in zip(slow, p.tolist())]
    assert np.allclose(r, slow)
    share = (r * n) @ p / ((r * n) @ p).sum()
    assert np.allclose(share, [mixing.TARGETS[x] for x in model.domains], atol=0.005)
    assert all(x["copies"] in (0, 1) for x in rows) and abs(np.mean([x["copies"] for x in rows]) - r.mean()) < 0.04
    model, steps, member = mixing.plan(d, named, {"toxic": 0.5, "clean": 0.5}, most=None)
    rows = mixing.with_rates(member, steps, None).collect()
    total = sum(np.array(x["p"]) * x["rate"] * x["n_words"] for x in rows)
    assert max(x["copies"] for x in rows) > 1 and np.allclose((total / total.sum())[[0, 2]], 0.5, atol=0.02)


def test_mixing_learns_from_the_labels_of_its_input(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_DOMAIN", 10)
    texts = {"clean": "good words here", "junk": "xx yy zz"}
    rows = [(i, "junk" if i % 2 else "clean") for i in range(400)]
    named = spark.createDataFrame(rows, "doc_id bigint, domain string")
    # a stage before has dropped all but 20 of the 200 labelled junk rows
    left = [(i, texts[d]) for i, d in rows if d == "clean" or i < 40]
    docs = spark.createDataFrame(left, "doc_id bigint, text string")
    seen = []
    fit = mixing._fit
    monkeypatch.setattr(mixing, "_fit", lambda x, y, k: seen.append(np.bincount(y).tolist()) or fit(x, y, k))
    model = mixing.train(docs, named)
    alone = mixing.train(docs, named.join(docs, "doc_id", "left_semi"))
    assert model.domains == ["clean", "junk"] and seen == [[10, 10], [10, 10]]
    assert np.allclose(model.bias, alone.bias) and np.allclose(model.weights, alone.weights)


def test_mixing_repeats_scarce_domains_up_to_a_bound(spark):
    kinds = {"clean": ([0.9995, 0.0001, 0.0004], 3000), "junk": ([0.01, 0.98, 0.01], 4), "toxic": ([0.02, 0.0, 0.98], 200)}
    rows = [(100, p, random.Random(k + str(i)).random()) for k, (p, m) in kinds.items() for i in range(m)]
    member = spark.createDataFrame(rows, "n_words bigint, p array<double>, u double").repartition(3)
    steps = mixing.fit_rates(member, list(kinds), mixing.TARGETS)
    out = mixing.with_rates(member, steps).toPandas()
    p, n = np.stack(out.p), out.n_words.to_numpy(float)
    for times in (out.rate, out.copies):
        total = (times.to_numpy() * n) @ p
        assert np.allclose(total / total.sum(), list(mixing.TARGETS.values())[:1] + [0.02, 0.02], atol=0.003)
    assert np.allclose(list(steps.reached.values()), (out.rate.to_numpy() * n) @ p)
    # the largest domain keeps all its words, and only the scarce one is repeated
    assert steps.reached["clean"] > 0.998 * n @ p[:, 0]
    assert out.copies[p[:, 1] > 0.5].min() > 5 and out.copies[p[:, 2] > 0.5].max() == 1
    with pytest.warns(UserWarning, match="junk wants .* words and reaches"):
        steps = mixing.fit_rates(member, list(kinds), mixing.TARGETS, repeats=2.0)
    assert mixing.with_rates(member, steps).agg(F.max("rate")).first()[0] <= 2 and steps.reached["junk"] < steps.wanted["junk"]


def test_mixing_copies_whole_rows(spark):
    docs = edge_docs(spark)
    weights = np.zeros((mixing.BUCKETS, 2))
    model = mixing.Posterior(["a", "b"], weights, np.zeros(2))
    out = mixing.apply_rates(docs, model, [np.array([-2.0, -2.0])], most=None)
    # every text with words has rate 3, the others keep rate 1
    want = [r["doc_id"] for r in docs.collect() for _ in range(3 if (r["text"] or "").split() else 1)]
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(want, key=str)
    assert mixing.apply_rates(docs, None, []).count() == docs.count()


def slow_chunks(text: bytes):
    """The cuts of one text, byte by byte."""
    out, start = [], 0
    for i in range(len(text)):
        size = i + 1 - start
        h = sum(int(bytehash._GEAR[text[i - k]]) << k for k in range(min(16, i + 1))) % (1 << 32)
        mask = int(fingerprints.STRICT) if size <= fingerprints.NORMAL else int(fingerprints.LOOSE)
        if size >= fingerprints.MOST or size >= fingerprints.LEAST and not h & mask:
            out.append(text[start:i + 1])
            start = i + 1
    return out + ([text[start:]] if start < len(text) else [])


def test_chunks_against_brute_force():
    texts = [(t or "").encode() for t in [r[1] for r in edge_rows()][:5] + WEIRD] + [sentence(s, 90).encode() for s in range(8)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    ends, first = fingerprints.cuts(data, off)
    sets = list(fingerprints.chunk_sets(data, off))
    for i, t in enumerate(texts):
        want = slow_chunks(t)
        cut = [off[i], *ends[first[i]:first[i + 1]]]
        assert [bytes(data[a:b]) for a, b in zip(cut, cut[1:])] == want
        assert sets[i][1].sum() == sum(map(len, set(want))) and len(sets[i][0]) == len(set(want))


def test_fingerprints_against_brute_force(spark, tmp_path):
    docs = documents(spark, SF_SMALL)
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.op10_document_fingerprints(spark, SF_SMALL).collect()}
    for i, r in enumerate(rows):
        t, nxt = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        g, a = got[r["doc_id"]], set(slow_chunks(t.encode()))
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            b = set(slow_chunks(other.encode()))
            want = sum(len(x) for x in a & b) / sum(map(len, a)) if a and b else float(not a and not b)
            assert abs(g[name] - want) < 1e-9
        assert (g["fingerprint"] == g["edited_fingerprint"]) == (a == set(slow_chunks(edited.encode())))


def test_next_documents_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BLOCK", 7)
    rows = [(i * i % 1009, f"text {i}") for i in range(200)] + [(5000, "a"), (5000, "b"), (None, "n"), (-3, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=str)
    assert sorted((tuple(r) for r in fingerprints.next_documents(d).collect()), key=str) == want
    one = spark.createDataFrame([(1, "only")], "doc_id bigint, text string")
    assert [tuple(r) for r in fingerprints.next_documents(one).collect()] == [(1, "only", "only")]


def test_pipeline_against_its_stages_one_by_one(spark, tokenizer):
    import corpus_pipeline
    docs = documents(spark, SF_CHECK)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_CHECK).collect()}
    good = {r["doc_id"] for r in quality.score(docs, quality.train(docs)).collect() if r["kept"]}
    left = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    seen, one = set(), []
    for i in sorted(left):
        text = " ".join(__import__("re").split(r"[\x20\x09-\x0d]+", left[i]["text"]))
        if text not in seen:
            one.append(i)
        seen.add(text)
    groups = slow_components(one, [slow_simhash(left[i]["text"]) for i in one])
    stay = [i for i, c in zip(one, groups) if i == c]
    kept = docs.filter(F.col("doc_id").isin(stay))
    named = labels(spark, SF_CHECK).select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    _, steps, member = mixing.plan(kept, named.filter("domain <> 'junk'"), corpus_pipeline.TARGETS)
    taken = sorted(r["doc_id"] for r in mixing.with_rates(member, steps).collect() if r["copies"])
    assert sorted(got) == taken
    for i in taken:
        ids = tokenizer.encode(left[i]["text"], add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(left[i]["text"].encode()).hexdigest()


def test_pipeline_stages_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    from .cases import empty_docs, write_tables
    for docs in (edge_docs(spark), empty_docs(spark)):
        folder = write_tables(spark, tmp_path, docs, [(7, 1, 0), (49, 0, 0), (None, None, 1)])
        d = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, folder)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == d.columns, name
                d = out
            out.count()


def test_exact_and_near_stages_agree_on_columns(spark):
    docs = edge_docs(spark)
    assert exact_dedup.drop_exact_duplicates(docs).schema == docs.schema
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
