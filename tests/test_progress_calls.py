"""Exactly-once progress log and model calls that are asked once per prompt."""

import functools
import glob
import os
import tempfile
import time
import uuid

import pytest
from pyspark.sql import functions as F

from turnwise.plans import jobs
from turnwise.plans import predict as P
from turnwise.sources.progress import ProgressLog

from .test_entities_booking import _entities
from .test_predict import ALLOWED, BELIEF, BOOK, GOALS, TURNS, response_model, state_model


def _dir():
    return tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp")


def _docs(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "dialogue_name string, size long").repartition(3)


def test_appends_count_once_and_lines_follow_commits(spark):
    log = ProgressLog(spark, f"{_dir()}/log")
    with pytest.raises(FileNotFoundError):
        log.read()
    assert log.append(_docs(spark, "ab"), "run1", 0, ["dialogue_name"])
    assert log.append(_docs(spark, "cde"), "run2", 0, ["dialogue_name"])
    assert not log.append(_docs(spark, "zzz"), "run1", 0)           # a repeat of a batch does nothing
    assert log.append(_docs(spark, []), "run1", 1)
    assert log.append(_docs(spark, "a"), "run1", 2)
    got = [(r.line_no, r.run_id, r.batch_id, r.dialogue_name) for r in log.read().orderBy("line_no").collect()]
    assert got == [(0, "run1", 0, "a"), (1, "run1", 0, "b"), (2, "run2", 0, "c"), (3, "run2", 0, "d"), (4, "run2", 0, "e"),
                   (5, "run1", 2, "a")]
    from turnwise.operators.sampling import latest_per_key
    last = {r.dialogue_name: r.line_no for r in latest_per_key(log.read(), ["dialogue_name"], "line_no").collect()}
    assert last == {"a": 5, "b": 1, "c": 2, "d": 3, "e": 4}


def test_killed_between_write_and_commit(spark, monkeypatch):
    """The stream's sink dies after its files are written; the restarted stream loses and repeats nothing."""
    d = _dir()
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{d}/src")
    log = ProgressLog(spark, f"{d}/log")

    def run():
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{d}/src")
        q = s.writeStream.foreachBatch(log.sink("run", ["id"])).option("checkpointLocation", f"{d}/ckpt").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    commit, seen = ProgressLog._commit, []

    def die(self, run_id, batch_id, attempt, n):
        seen.append(batch_id)
        if batch_id == 2 and seen.count(2) == 1:
            raise KeyError("killed")
        commit(self, run_id, batch_id, attempt, n)
        if batch_id == 3 and seen.count(3) == 1:
            raise KeyError("killed after the commit, before the stream notes it")
    monkeypatch.setattr(ProgressLog, "_commit", die)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    rows = log.read().orderBy("line_no").collect()
    assert sorted(r.id for r in rows) == list(range(40)) and [r.line_no for r in rows] == list(range(40))
    assert len(glob.glob(f"{d}/log/data/attempt=*")) == 5           # one of them counts for nothing
    assert log.manifest().count() == 4


def slow_model(text, folder, wait=0.05):
    """Answers after a while and leaves a file for every call."""
    open(os.path.join(folder, uuid.uuid4().hex), "w").close()
    time.sleep(wait)
    if text == "bad" and not os.path.exists(os.path.join(folder, "cured")):
        raise ValueError("no")
    return f"<{text}>"


def test_each_prompt_is_asked_once_and_stored(spark):
    d = _dir()
    calls = os.path.join(d, "calls")
    os.mkdir(calls)
    model = functools.partial(slow_model, folder=calls, wait=0.0)
    df = spark.createDataFrame([(i, f"p{i % 7}" if i % 11 else None) for i in range(200)] + [(900, "bad")], "k long, prompt string")
    ask = lambda x, waves=1: {r.k: (r.out, r.error) for r in jobs.ask_all(x, "prompt", "out", model, f"{d}/store", 4, waves).collect()}
    got = ask(df, 3)
    assert got[1] == ("<p1>", None) and got[0] == ("<>", None) and got[900] == (None, "ValueError: no") and len(got) == 201
    assert len(os.listdir(calls)) == 9                              # 7 prompts, the empty one, the bad one
    open(os.path.join(calls, "cured"), "w").close()
    more = df.unionByName(spark.createDataFrame([(1000, "new"), (1001, "p3")], "k long, prompt string"))
    got = ask(more)
    assert got[1000] == ("<new>", None) and got[1001] == ("<p3>", None) and got[900] == ("<bad>", None)
    assert len(os.listdir(calls)) == 9 + 1 + 2                      # the mark, the new prompt, the bad one again
    assert ask(more) == got and len(os.listdir(calls)) == 12


def test_wall_time_falls_with_the_window(spark):
    d = _dir()
    df = spark.createDataFrame([(f"q{i}",) for i in range(48)], "prompt string").coalesce(1)
    took = {}
    jobs.ask_all(df.limit(1), "prompt", "out", functools.partial(slow_model, folder=_dir()), f"{d}/warm").collect()
    for window in (1, 16):
        t = time.time()
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")         # one task: only the window differs
        try:
            assert jobs.ask_all(df, "prompt", "out", functools.partial(slow_model, folder=_dir(), wait=0.15), f"{d}/{window}",
                                window).filter(F.col("out").isNull()).count() == 0
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        took[window] = time.time() - t
    assert took[16] < took[1] - 3                                   # 48 calls: 7.2 s one by one, 0.5 s by sixteen


def test_predict_job_with_stored_answers(spark):
    d = _dir()
    rows = [(conv, 2 * i + j, who, u if not j else "ok") for conv, users in TURNS.items() for i, u in enumerate(users)
            for j, who in enumerate(("USER", "SYSTEM"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, speaker string, utterance string")
    _, ents = _entities(spark)
    goals = spark.createDataFrame(GOALS, "conv_id long, domain string, booking map<string,string>")
    args = (turns, state_model, response_model, BELIEF, BOOK, ents, goals, ALLOWED)
    ask = lambda df, i, o, m: jobs.ask_all(df, i, o, m, f"{d}/{o}{m.__name__}", 4)
    plain = P.predict_turns(*args, k=5).drop("belief_state", "book_state")
    stored = P.predict_turns(*args, k=5, ask=ask).select(*plain.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
