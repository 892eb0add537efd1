"""Jobs: model calls with retries, pandas predictors, two-step tracking vs a sequential
memory, example index round trip."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from turnwise.plans import jobs as J
from turnwise.sources import files as FL


def test_guarded_retries_and_errors():
    calls = {"n": 0}

    def flaky(text):
        calls["n"] += 1
        if text == "boom":
            raise RuntimeError("rate limited")
        if text == "once" and calls["n"] == 1:
            raise RuntimeError("transient")
        return f"  ok {text} "

    out = J.guarded(flaky, max_attempts=3, retry_on=(RuntimeError,), base_wait=0.0)(pd.Series(["once", "boom", "x"]))
    assert out["value"].tolist() == ["ok once", None, "ok x"]
    assert out["error"].tolist()[1].startswith("RuntimeError")
    assert out["attempts"].tolist() == [2, 3, 1]


def test_run_predictor_and_error_text(spark):
    df = spark.createDataFrame([(1, "hi"), (2, None)], "k long, t string")
    got = dict(J.run_predictor(df, "t", "p", J.echo_predictor).select("k", "p").collect())
    assert got == {1: "Re: hi", 2: "Re: "}
    e = spark.createDataFrame([(1, "  fine \n", None), (2, "x", "timeout")], "k long, raw string, err string")
    got = dict(J.call_with_errors(e, "raw", "err").select("k", "prediction").collect())
    assert got == {1: "fine", 2: "Error: timeout"}


def _sequential(rows, domain_slots):
    """Memory merge exactly as a per-turn loop would do it."""
    out = {}
    mem = {}
    for key, t, gtext, dtext in sorted(rows, key=lambda r: (r[0], r[1])):
        m = mem.setdefault(key, {("general", "active_domain"): None, ("general", "city"): None})
        g = {}
        for item in (gtext.split(", ") if gtext else []):
            p = item.split(" ", 1)
            if len(p) == 2 and p[0] in ("active_domain", "city"):
                g[p[0]] = p[1]
        active = g.get("active_domain") or "general"
        d = {}
        slots = domain_slots.get(active, ["active_domain", "city"] if active == "general" else [])
        for item in (dtext.split(", ") if dtext else []):
            p = item.split(" ", 1)
            if len(p) == 2 and p[0] in slots:
                d[p[0]] = p[1]
        for s, v in g.items():
            if v:
                m[("general", s)] = v
        for s, v in d.items():
            if v:
                m[(active, s)] = v
        order = [("general", "active_domain"), ("general", "city")] + [(dd, s) for dd, ss in domain_slots.items() for s in ss]
        out[(key, t)] = ", ".join(f"{dd} {s} {m[(dd, s)]}" for dd, s in order if m.get((dd, s)))
    return out


def test_two_step_state_equals_sequential(spark):
    import random
    rnd = random.Random(8)
    dom = {"hotel": ["name", "area"], "taxi": ["day"]}
    rows = []
    for i in range(200):
        active = rnd.choice(["hotel", "taxi", "", "bogus"])
        g = ", ".join(x for x in [f"active_domain {active}" if active else "", rnd.choice(["city kyoto", "", "city"])] if x)
        d = rnd.choice(["name a, area b", "area c", "", "day mon", "name", "area x, area y"])
        rows.append((rnd.randrange(4), i, g, d))
    df = spark.createDataFrame(rows, "u long, t long, general_text string, domain_text string")
    got = {(r.u, r.t): r.state for r in J.two_step_state(df, ["u"], ["t"], dom).collect()}
    assert got == _sequential(rows, dom)


def test_index_round_trip(spark):
    d = tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp")
    ex = spark.createDataFrame([(1, "ctx", [0.1, 0.2])], "example_id long, context_text string, embedding array<float>")
    FL.write_index(ex, os.path.join(d, "idx"), {"context_turns": 2, "user_utterance_prefix": "U"},
                   spark.createDataFrame([("hotel", 3)], "domain string, n long"))
    back, args = FL.read_index(spark, os.path.join(d, "idx"))
    assert back.count() == 1 and args["context_turns"] == 2 and args["user_utterance_prefix"] == "U"
    assert spark.read.json(os.path.join(d, "idx.domain_counter")).filter(F.col("n") == 3).count() == 1


def test_fewshot_retrieval_with_hashed_embeddings(spark):
    import numpy as np

    from turnwise.functions.embed import embed_hashed
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["book a hotel in kyoto", "taxi to the station", "cheap italian restaurant", "weather tomorrow in osaka",
         "hotel with parking", "restaurant near the station"])], "example_id long, context_text string")
    qs = spark.createDataFrame([(100, "i need a hotel"), (101, "a restaurant please"), (102, "taxi")],
                               "query_id long, context_text string")
    got = {(r.query_id, r.rank): r.example_id for r in J.fewshot_retrieval(docs, qs, 2).collect()}
    dv = {r.example_id: np.array(r.embedding, dtype=np.float64) for r in embed_hashed(docs, "context_text").collect()}
    for r in embed_hashed(qs, "context_text").collect():
        q = np.array(r.embedding, dtype=np.float64)
        assert abs(np.linalg.norm(q) - 1) < 1e-5
        ids = sorted(dv)
        d = np.array([((dv[i] - q) ** 2).sum() for i in ids])
        order = [ids[j] for j in np.lexsort((np.array(ids), d))[:2]]
        assert [got[(r.query_id, 1)], got[(r.query_id, 2)]] == order
    assert got[(100, 1)] in (0, 4)


def test_missing_dialogue_is_reported(spark):
    import pytest

    from turnwise.operators import sampling as SMP
    splits = spark.createDataFrame([("test", 0, 1), ("test", 1, 9)], "split string, split_pos long, conv_id long")
    turns = spark.createDataFrame([(1, 0), (1, 1)], "conv_id long, turn long")
    assert [r.conv_id for r in SMP.split_missing(splits, turns).collect()] == [9]
    assert SMP.split_assign(splits.filter("conv_id = 1"), turns).first().n_turns == 2
    with pytest.raises(Exception, match="dialogue not in the corpus: 9"):
        SMP.split_assign(splits, turns).collect()


def test_prompts_with_retrieved_examples(spark):
    """Index rows and queries are rendered with the stored arguments; the examples are the nearest rows."""
    from turnwise.operators import prompts as PR
    folder = tempfile.mkdtemp()
    turns = spark.createDataFrame([(c, t, "USER" if t % 2 == 0 else "SYSTEM", f"{w} {w}{t}") for c, w in
                                   ((1, "rooms"), (2, "trains"), (3, "rooms")) for t in range(6)],
                                  "conv_id long, turn long, speaker string, utterance string")
    args = {"context_turns": 2, "user_prefix": "U", "system_prefix": "V"}
    ctx = J.query_contexts(turns, args).withColumn("id", F.col("conv_id") * 10 + F.col("turn"))
    docs = ctx.filter("conv_id <> 3").select(F.col("id").alias("example_id"), "context_text",
                                             F.concat(F.lit("#"), "id").alias("state_text"), F.lit("d").alias("db_text"),
                                             F.lit("").alias("book_text"), F.col("utterance").alias("response"))
    FL.write_index(docs, os.path.join(folder, "index"), args)
    index, stored = FL.read_index(spark, os.path.join(folder, "index"))
    queries = J.query_contexts(turns.filter("conv_id = 3"), stored).select(F.col("turn").alias("query_id"), "context_text")
    assert queries.filter("query_id = 3").first().context_text == "V rooms rooms1 U rooms rooms2"
    got = {r.query_id: r for r in J.with_examples(queries, index, 2).collect()}
    # the same context stands in dialogue 1, so it is the first example
    assert all(r.examples[0].context_text == r.context_text and len(r.examples) == 2 for r in got.values())
    assert all(e.context_text.startswith(("U rooms", "V rooms")) for r in got.values() for e in r.examples)
    few = J.with_examples(queries, index, 1).select(PR.state_prompt(F.lit("T\n"), F.col("context_text"), F.col("examples")).alias("p"))
    zero = J.with_examples(queries, index, 0).select(PR.state_prompt(F.lit("T\n"), F.col("context_text"), F.col("examples")).alias("p"))
    assert all("#1" in r.p for r in few.collect()) and not any("#1" in r.p for r in zero.collect())


def test_materialized_tables_are_released(spark):
    import os

    from turnwise.operators import joins
    joins.release_materialized(spark)
    d = joins.materialize(spark.range(10))
    folder = os.path.dirname(d.inputFiles()[0].removeprefix("file://"))
    assert d.count() == 10 and os.path.isdir(folder)
    assert joins.release_materialized(spark) == 1 and not os.path.exists(folder)
    assert joins.release_materialized(spark) == 0
