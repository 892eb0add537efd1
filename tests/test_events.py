"""Event-time streams: shuffled inputs, late rows, idle sessions, tombstones, and reading the state."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from turnwise import schemas as S
from turnwise.operators import sessions as SE
from turnwise.operators import state as ST
from turnwise.streaming import events as EV

from .conftest import SF_SMALL, rows

INPUT = "session_id long, seq long, ts timestamp, input_text string, answer string"


@pytest.fixture
def rocks(spark):
    s = spark.newSession()
    EV.use_rocksdb(s)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


def _dir():
    return tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp")


class Feed:
    """A folder that is streamed one file a micro-batch."""

    def __init__(self, spark, schema, build, name):
        self.spark, self.schema, self.dir, self.n = spark, schema, _dir(), 0
        self.name, self.checkpoint = name, os.path.join(self.dir, "checkpoint")
        self.build = build

    def add(self, batch):
        df = self.spark.createDataFrame(batch, self.schema) if isinstance(batch, list) else batch
        df.coalesce(1).write.mode("append").parquet(os.path.join(self.dir, "src"))
        return self

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(self.dir, "src"))
        q = (self.build(stream).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", self.checkpoint).start(os.path.join(self.dir, "out")))
        try:
            q.processAllAvailable()
            return q.lastProgress
        finally:
            q.stop()

    def out(self):
        return self.spark.read.parquet(os.path.join(self.dir, "out"))


def _at(minute):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def _row(session, minute, text, seq=None):
    return (session, minute if seq is None else seq, _at(minute), text, f"answer {minute}")


def _sessions(**kw):
    return lambda s: EV.session_events(s, 6, **({"lateness": "30 minutes", "idle_ms": 10**12, "tombstone_ms": 10**12} | kw))


def test_shuffled_inputs_equal_the_batch_fold(rocks):
    rng = random.Random(2)
    data = [_row(s, 10 * k + s, rng.choice(["hi", "more", S.SUCCESS_PHRASE if k > 2 else "x", S.FAILURE_PHRASE if k > 4 else "y"]))
            for s in range(5) for k in range(rng.randrange(1, 9))]
    mixed = list(data)
    rng.shuffle(mixed)
    # micro-batches in any order within the lateness of 200 minutes
    feed = Feed(rocks, INPUT, _sessions(lateness="200 minutes"), "shuffled")
    for i in range(0, len(mixed), 9):
        feed.add(mixed[i:i + 9])
    feed.add([_row(99, 100_000, "far later")])
    feed.run()
    cols = ["session_id", "seq", "status", "ends_session", "response"]
    want = SE.session_fold(rocks.createDataFrame(data, INPUT), 6, answer="answer")
    assert rows(feed.out(), cols) == rows(want, cols)


def test_late_rows_come_out_as_such(rocks):
    feed = Feed(rocks, INPUT, _sessions(), "late")
    feed.add([_row(1, 0, "a"), _row(1, 5, "b")]).run()
    feed.add([_row(2, 100, "on")]).run()              # watermark: minute 70
    feed.add([_row(1, 3, "too late"), _row(1, 71, "in time")]).run()
    feed.add([_row(3, 1000, "on")]).run()
    folded, late = EV.late_rows(feed.out())
    assert rows(late, ["session_id", "seq", "status"]) == [(1, 3, "late")]
    assert rows(folded.filter("session_id = 1"), ["seq", "status"]) == [(0, "exchange"), (5, "exchange"), (71, "exchange")]


def test_idle_sessions_end_and_their_state_goes(rocks):
    feed = Feed(rocks, INPUT, _sessions(idle_ms=60 * 60_000, tombstone_ms=60 * 60_000), "idle")
    feed.add([_row(1, 0, "a"), _row(1, 10, "b"), _row(2, 0, S.SUCCESS_PHRASE)]).run()
    feed.add([_row(9, 101, "on")]).run()              # watermark: minute 71; session 1 has been idle for 61
    feed.add([_row(1, 80, "too long after")]).run()
    feed.add([_row(9, 115, "on")]).run()              # watermark: 85
    out = feed.out().filter("session_id = 1")
    assert rows(out, ["seq", "status", "ends_session"]) == [
        (0, "exchange", False), (10, "exchange", False), (80, "after_end", False), (None, "timeout", True)]
    assert feed.out().filter("session_id = 2").count() == 1
    assert {r.session_id for r in EV.held_sessions(rocks, feed.checkpoint).collect()} >= {1}
    progress = feed.add([_row(9, 5000, "on")]).run()
    progress = feed.add([_row(9, 9000, S.SUCCESS_PHRASE)]).run()
    progress = feed.add([_row(10, 20_000, "last")]).run()
    left = {r.session_id for r in EV.held_sessions(rocks, feed.checkpoint).collect()}
    assert left == set() and progress["stateOperators"][0]["numRowsTotal"] <= 4  # session 10 waits: row, clock, timer


def test_export_of_a_stopped_query_holds_the_sessions_without_scores(rocks):
    feed = Feed(rocks, INPUT, _sessions(), "export")
    feed.add([_row(1, 0, "a"), _row(1, 2, "b"), _row(2, 1, S.SUCCESS_PHRASE), _row(3, 2, "c"), _row(4, 3, "d")]).run()
    feed.add([_row(9, 500, "on")]).run()
    scores = rocks.createDataFrame([(2, "5"), (3, "4")], "session_id long, q1 string")
    got = {r.session_id: r for r in EV.unfinished_sessions(rocks, feed.checkpoint, scores).collect()}
    assert set(got) == {1, 4} and [x.input_text for x in got[1].log] == ["a", "b"]
    assert (got[1].n_exchanges, got[1].ended) == (2, False)
    feed.add([_row(1, 501, S.SUCCESS_PHRASE)]).run()  # the query goes on from its checkpoint
    feed.add([_row(9, 900, "on")]).run()
    assert {r.session_id: r.end_reason for r in EV.held_sessions(rocks, feed.checkpoint).collect()}[1] == "success"


def test_slot_memory_in_any_order_equals_carry_forward(rocks):
    from turnwise.plans.queries_state import EV_SLOTS, _updates_wide
    wide = _updates_wide(rocks, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    ids = [r[0] for r in wide.select("user_id").distinct().orderBy("user_id").limit(8).collect()]
    wide = wide.filter(F.col("user_id").isin(ids)).select("user_id", "ts", "event_id", *EV_SLOTS)
    schema = wide.schema
    feed = Feed(rocks, schema, lambda s: EV.slot_memory_events(
        s, "user_id", "ts", "event_id", EV_SLOTS, lateness="4000 days", idle_ms=10**15), "memory")
    every = wide.collect()
    random.Random(1).shuffle(every)
    for i in range(0, len(every), max(1, len(every) // 4)):
        feed.add(rocks.createDataFrame(every[i:i + max(1, len(every) // 4)], schema))
    import datetime
    far = max(r.ts for r in every) + datetime.timedelta(days=8000)
    feed.add(rocks.createDataFrame([(-1, far, -1, *[None] * len(EV_SLOTS))], schema))
    feed.run()
    cols = ["user_id", "event_id", *EV_SLOTS]
    assert rows(feed.out(), cols) == rows(ST.carry_forward(wide, ["user_id"], ["ts", "event_id"], EV_SLOTS), cols)


def test_without_rocksdb_there_is_a_clear_error(spark):
    with pytest.raises(RuntimeError, match="RocksDB"):
        EV.session_events(spark.readStream.schema(INPUT).parquet(_dir()))
