"""Row checks in one pass, and exchange logs with states and results."""

import os
import tempfile

from pyspark.sql import functions as F

from turnwise.operators import checks as CH
from turnwise.operators import sampling as SMP
from turnwise.operators import sessions as SE
from turnwise.sources import files as FL
from turnwise.sources import fixtures as FX
from turnwise.sources import sinks as SK

from .conftest import SF_CHECK, rows


def _dir():
    return tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp")


def _jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counts_equal_the_separate_queries_in_one_pass(spark):
    c = FX.table(spark, SF_CHECK, "conversations").withColumn("role", F.when(F.col("turn") % 7 == 3, "robot").when(
        F.col("turn") % 11 == 5, F.lit(None).cast("string")).otherwise(F.col("role")))
    splits = FX.v_splits(spark, SF_CHECK).select("conv_id", "split").unionByName(
        spark.createDataFrame([(10**9, "train"), (10**9 + 1, "dev")], "conv_id long, split string"))
    rules = {"speaker": F.col("role").isin("user", "assistant"), "text": F.length("text") > 20}
    spark.sparkContext.setJobGroup("checked", "one pass")
    got = CH.write_checked(c, rules, f"{_dir()}/checked")
    spark.sparkContext.setJobGroup("other", "")
    assert _jobs(spark, "checked") == 1
    bad = SMP.bad_speakers(c, role="role", allowed=("user", "assistant"))
    short = c.filter(~F.coalesce(F.length("text") > 20, F.lit(False)))
    assert got.rows == c.count() and got.failures == {"speaker": bad.count(), "text": short.count()}
    assert got.failures["speaker"] > 0
    key = ["conv_id", "turn", "role", "text"]
    assert rows(got.quarantine, key) == rows(bad.unionByName(short).distinct(), key)
    assert rows(got.good, key) == rows(c.exceptAll(bad.unionByName(short).distinct()), key)
    plan = CH.with_failures(c, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    # names of split lists that the corpus does not have
    joined = SMP.split_assign(splits.withColumn("split_pos", F.lit(0)), FX.v_turns(spark, SF_CHECK), missing="keep")
    found = CH.write_checked(joined, {"known": F.col("n_turns").isNotNull()}, f"{_dir()}/splits")
    assert found.failures == {"known": 2} and {r.conv_id for r in found.quarantine.collect()} == {10**9, 10**9 + 1}


def test_no_rules_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "k long, t string")
    got = CH.write_checked(d, {}, f"{_dir()}/a")
    assert (got.rows, got.failures, got.good.count(), got.quarantine.count()) == (2, {}, 2, 0)
    got = CH.write_checked(d, {"a": F.col("t") == "x", "b": F.col("k") > 1}, f"{_dir()}/b")
    assert [tuple(r) for r in got.quarantine.collect()] == [(1, None, ["a", "b"])] and got.failures == {"a": 1, "b": 1}
    got = CH.write_checked(d.limit(0), {"a": F.col("t") == "x"}, f"{_dir()}/c")
    assert (got.rows, got.failures, got.good.count()) == (0, {"a": 0}, 0)


def test_logs_hold_states_and_results_and_come_back(spark):
    schema = ("session_id string, seq long, input_text string, answer string, belief_state map<string,map<string,string>>, "
              "book_state map<string,map<string,string>>, db_result struct<candidate_entities:array<string>,active_entity:"
              "map<string,string>>, book_result map<string,struct<success:boolean,ref:string>>")
    data = [("s1", i, t, f"a{i}", {"hotel": {"area": f"x{i}"}}, {"hotel": {"people": "2"}}, (["inn"], {"name": "inn"}),
             {"hotel": (True, "7")}) for i, t in ((2, "two"), (0, "zero"), (1, "one"))]
    data.append(("s2", 0, "hi", "there", None, None, None, None))
    folded = SE.session_fold(spark.createDataFrame(data, schema), 6, answer="answer")
    log = SE.session_log(folded)
    out = os.path.join(_dir(), "done")
    SK.export_sessions(log.withColumn("eval_scores", F.array(F.lit("3"))), out, os.path.join(_dir(), "open"))
    got = {r.session_id: r.log for r in FL.read_sessions(spark, out, lines=True).collect()}
    assert [(e.input_text, e.belief_state["hotel"]["area"]) for e in got["s1"]] == [("zero", "x0"), ("one", "x1"), ("two", "x2")]
    e = got["s1"][2]
    assert e.db_result.active_entity == {"name": "inn"} and e.book_result["hotel"].ref == "7" and e.session_over
    assert e.book_state == {"hotel": {"people": "2"}} and e.response.startswith("a2")
    assert got["s2"][0].db_result is None and not got["s2"][0].session_over
