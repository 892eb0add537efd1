"""Balanced sampling vs the sequential walk, kNN vs brute force, BLEU vs a direct
implementation, session fold rules, progress log, ordinal positions."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.functions.text import ws_tokens
from turnwise.operators import bleu as BL
from turnwise.operators import knn as KN
from turnwise.operators import sampling as SMP
from turnwise.operators import sessions as SE
from turnwise.operators.ordering import ordinal


def _sample(spark, goals, quota):
    rows = [(p, d) for p, ds in goals.items() for d in ds]
    got = SMP.balanced_sample(spark.createDataFrame(rows, "pos long, domain string"), quota)
    return sorted(r.pos for r in got.collect())


def test_balanced_sample_by_hand(spark):
    goals = {0: ["a"], 1: ["a", "b"], 2: ["a"], 3: ["b"], 4: ["c"], 5: ["a", "c"]}
    # quota 1: 0 fills a; 1 is the first of b; 4 is the first of c; 2, 3 and 5 have only filled domains
    assert _sample(spark, goals, 1) == [0, 1, 4]
    # quota 2: 2 has only a, which 0 and 1 have filled; 3 is the second of b, 4 and 5 those of c
    assert _sample(spark, goals, 2) == [0, 1, 3, 4, 5]
    assert _sample(spark, goals, 0) == []
    assert _sample(spark, goals, 9) == [0, 1, 2, 3, 4, 5]


def test_balanced_sample_properties(spark):
    rnd = random.Random(11)
    goals = {i: sorted(set(rnd.sample("abcd", rnd.randint(1, 3)))) for i in range(60)}
    for quota in (1, 3):
        taken = _sample(spark, goals, quota)
        for pos, domains in goals.items():
            # taken if and only if fewer than quota earlier dialogues with one of its domains were taken
            open_ = [d for d in domains if sum(d in goals[p] for p in taken if p < pos) < quota]
            assert (pos in taken) == bool(open_)
        gd = spark.createDataFrame([(p, d) for p, ds in goals.items() for d in ds], "pos long, domain string")
        domains = spark.createDataFrame([(d,) for d in "abcd"], "domain string")
        counts = {r.domain: r.n for r in SMP.domain_counts(gd, SMP.balanced_sample(gd, quota), domains).collect()}
        assert counts == {d: sum(d in goals[p] for p in taken) for d in "abcd"}


def test_knn_exact_matches_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(len(v))], "vec_id long, embedding array<float>")
    got = KN.knn_exact(df, df, 3, qid="vec_id", cid="vec_id", vec="embedding", exclude_self=True, q_blocks=3, c_blocks=4)
    got = {(r.vec_id, r.rank): r.nn_vec_id for r in got.collect()}
    vd = v.astype(np.float64)
    for i in range(len(v)):
        d = ((vd - vd[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        order = np.lexsort((np.arange(len(v)), d))[:3]
        assert [got[(i, r + 1)] for r in range(3)] == order.tolist()


def test_knn_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0] if i % 2 else [0.0, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = KN.knn_exact(df.filter("vec_id = 3"), df, 4, qid="vec_id", cid="vec_id", vec="embedding", exclude_self=True,
                       q_blocks=1, c_blocks=3)
    assert [(r["rank"], r.nn_vec_id, r.dist) for r in got.orderBy("rank").collect()] == [
        (1, 1, 0.0), (2, 5, 0.0), (3, 7, 0.0), (4, 9, 0.0)]


def _bleu_direct(hyp, ref):
    h, r = hyp.split(), ref.split()
    correct, total = [0] * 4, [0] * 4
    for n in range(1, 5):
        hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
        rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        correct[n - 1] = sum(min(c, rc[g]) for g, c in hc.items())
        total[n - 1] = sum(hc.values())
    if not any(correct):
        return 0.0
    bp = 1.0 if len(h) >= len(r) else (math.exp(1 - len(r) / len(h)) if h else 0.0)
    smooth, logs, eff = 1.0, [], 0
    for n in range(4):
        if total[n] == 0:
            break
        eff = n + 1
        if correct[n] == 0:
            smooth *= 2
            p = 100.0 / (smooth * total[n])
        else:
            p = 100.0 * correct[n] / total[n]
        logs.append(math.log(p))
    return bp * math.exp(sum(logs) / eff)


def test_bleu_matches_direct(spark):
    rnd = random.Random(2)
    words = "a b c d e f g".split()
    pairs = []
    for i in range(80):
        ref = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))
        hyp = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
        pairs.append((i, hyp, ref))
    df = spark.createDataFrame(pairs, "k long, hyp string, ref string")
    got = {r.k: r.bleu for r in BL.sentence_bleu(df, ["k"], ws_tokens(F.col("hyp")), ws_tokens(F.col("ref"))).collect()}
    for k, hyp, ref in pairs:
        assert abs(got[k] - _bleu_direct(hyp, ref)) < 1e-9, (hyp, ref)


def test_session_fold_rules(spark):
    inp = spark.createDataFrame([
        (1, 0, "hi"), (1, 1, "  SUCCESS "), (1, 2, "late"),            # success with spaces/case, then input after end
        (2, 0, "a"), (2, 1, "b"), (2, 2, "c"), (2, 3, "d"),              # limit: 2 exchanges = 4 utterances
        (3, 0, "fail"),
    ], "session_id long, seq long, input_text string").withColumn("model_name", F.lit("m"))
    f = {(r.session_id, r.seq): (r.status, r.ends_session) for r in SE.session_fold(inp, 4).collect()}
    assert f[(1, 1)] == ("success", True) and f[(1, 2)] == ("after_end", False)
    assert f[(2, 1)] == ("exchange", True) and f[(2, 2)] == ("after_end", False)
    assert f[(3, 0)] == ("failure", True)
    summ = {r.session_id: (r.n_exchanges, r.success, r.end_reason) for r in SE.session_summary(SE.session_fold(inp, 4)).collect()}
    assert summ == {1: (1, True, "success"), 2: (2, False, "limit"), 3: (0, False, "failure")}
    scores = spark.createDataFrame([(1, "3", "4", "5"), (9, "1", "1", "1")], "session_id long, q1 string, q2 string, q3 string")
    st = {r.session_id: r.status for r in SE.session_scores(inp, scores).collect()}
    assert st == {1: "scored", 2: "unscored", 3: "unscored", 9: "orphan"}


def test_progress_last_line_wins(spark):
    df = spark.createDataFrame([(1, 10, "old"), (1, 15, "new"), (2, 20, "only")], "conv_id long, line_no long, payload string")
    got = {r.conv_id: r.payload for r in SMP.latest_per_key(df, ["conv_id"], "line_no").collect()}
    assert got == {1: "new", 2: "only"}


def test_ordinal_equals_row_number(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice("xyz"), rnd.random()) for _ in range(500)], "g string, v double")
    w = Window.partitionBy("g").orderBy("v")
    b = {(r.g, r.v): r.rn - 1 for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    for parts in (1, 7):
        a = {(r.g, r.v): r.pos for r in ordinal(df, ["v"], ["g"], "pos", num_partitions=parts).collect()}
        assert a == b


def test_running_total_counts_strictly_earlier_rows(spark):
    from turnwise.operators.ordering import running_total
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), float(i), rnd.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    want = {(g, v): sum(x[2] for x in rows if x[0] == g and x[1] < v) for g, v, _ in rows}
    for parts in (1, 5):
        got = running_total(df, ["v"], ["g"], "w", num_partitions=parts).collect()
        assert {(r.g, r.v): r.before for r in got} == want


def test_work_parts_like_array_split(spark):
    names = list(range(10))
    df = spark.createDataFrame([("test", i, 100 + i) for i in names], "split string, split_pos long, conv_id long")
    got = [r.part for r in SMP.work_parts(df, 4).orderBy("split_pos").collect()]
    want = [p for p, chunk in enumerate(np.array_split(names, 4)) for _ in chunk]
    assert got == want


def test_corpus_bleu_matches_direct(spark):
    rnd = random.Random(21)
    words = "a b c d e".split()
    pairs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 15))),
              " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 15)))) for i in range(40)]
    df = spark.createDataFrame(pairs, "k long, hyp string, ref string")
    got = BL.corpus_bleu(df, ["k"], ws_tokens(F.col("hyp")), ws_tokens(F.col("ref"))).first()["bleu"]
    correct, total, hl, rl = [0] * 4, [0] * 4, 0, 0
    for _, hyp, ref in pairs:
        h, r = hyp.split(), ref.split()
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += sum(hc.values())
    bp = 1.0 if hl >= rl else math.exp(1 - rl / hl)
    smooth, logs = 1.0, []
    for n in range(4):
        if correct[n] == 0:
            smooth *= 2
            logs.append(math.log(100.0 / (smooth * total[n])))
        else:
            logs.append(math.log(100.0 * correct[n] / total[n]))
    assert abs(got - bp * math.exp(sum(logs) / 4)) < 1e-9
