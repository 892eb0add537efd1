"""Event-time streams: sessions and slot memories whose inputs arrive in any order.

Rows wait in list state until the watermark has passed them, so they are folded in event order whatever
micro-batch brought them; the results are those of the batch operators. A row at or before the
watermark on arrival is late: it is not folded and comes out at once with status 'late', so that a sink can
put it aside (``late_rows``). One timer per key wakes it for its next waiting row, or when it has been idle
for ``idle_ms`` of event time: an open session then ends with status 'timeout'. An ended session
stays as a tombstone for ``tombstone_ms`` more (inputs are 'after_end'), then all of its state is removed.

Needs the RocksDB state store (``use_rocksdb``). The sessions that a stopped or running query holds are
read from its checkpoint with the state data source (``held_sessions``, ``held_logs``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..operators.sessions import phrase_is

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and several state variables need, for streams started from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them and gives them to ``fold`` in event order.

    Subclasses name the columns of a row (``row_names``, ``row_schema``: the event time in milliseconds first,
    then what breaks its ties) and keep their own state."""

    def __init__(self, row_names: Sequence[str], row_schema: str, idle_ms: int, tombstone_ms: int):
        self.names, self.schema = list(row_names), row_schema
        self.idle_ms, self.tombstone_ms = idle_ms, tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        # wake: when the key's timer is due; last: event time of its last folded row
        self.clock = handle.getValueState("clock", "wake long, last long")

    def _wake_at(self, at: int | None, last: int) -> None:
        before = self.clock.get()[0] if self.clock.exists() else None
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        if at is not None and before != at:
            self.handle.registerTimer(at)
        self.clock.update((at, last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        late, held = [], []
        for pdf in rows:
            for r in zip(*(pdf[n].tolist() for n in self.names)):
                r = tuple(None if x is pd.NaT or (isinstance(x, float) and x != x) else x for x in r)
                (late if r[0] <= now else held).append(r)
        if held:
            self.waiting.appendList(held)
            wake, last = self.clock.get() if self.clock.exists() else (None, 0)
            first = min(r[0] for r in held)
            self._wake_at(first if wake is None else min(first, wake), last)
        if late:
            yield self.late_rows(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, last = self.clock.get()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(r for r in rows if r[0] <= now), [r for r in rows if r[0] > now]
        self.clock.update((None, last))  # the timer that rang is gone
        if due:
            last = due[-1][0]
            yield self.fold(key, due)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if not later and last + self.idle_ms <= now:
            out = self.idle(key, last + self.idle_ms)
            if out is not None:
                yield out
            if last + self.idle_ms + self.tombstone_ms <= now:
                self.clock.clear()
                self.forget()
                return
            self._wake_at(last + self.idle_ms + self.tombstone_ms, last)
        else:
            self._wake_at(min([r[0] for r in later], default=last + self.idle_ms), last)

    def close(self) -> None:
        pass

    def late_rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def fold(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def idle(self, key, at: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError


class _Sessions(_InOrder):
    """State: logged exchanges, whether the session is over, and the log (bounded by the turn limit)."""

    OUT = ["session_id", "ts_ms", "seq", "status", "ends_session", "response"]

    def __init__(self, max_turns: int, idle_ms: int, tombstone_ms: int):
        super().__init__(["ts_ms", "seq", "input_text", "answer"], "ts_ms long, seq long, input_text string, answer string",
                         idle_ms, tombstone_ms)
        self.max_turns = max_turns

    def init(self, handle):
        super().init(handle)
        self.session = handle.getValueState("session", "n_exchanges long, ended boolean, end_reason string")
        self.log = handle.getListState("log", "seq long, input_text string, response string, session_over boolean")

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=self.OUT).astype(
            {"ts_ms": "int64", "seq": "Int64", "status": object, "response": object})

    def late_rows(self, key, rows):
        return self._frame([(key[0], r[0], r[1], "late", False, None) for r in rows])

    def fold(self, key, rows):
        n, ended, reason = self.session.get() if self.session.exists() else (0, False, None)
        out, log = [], []
        for ts, seq, text, answer in rows:
            response, ends = None, False
            if ended:
                status = "after_end"
            elif phrase_is(text, S.SUCCESS_PHRASE) or phrase_is(text, S.FAILURE_PHRASE):
                status = "success" if phrase_is(text, S.SUCCESS_PHRASE) else "failure"
                ended, ends, reason, response = True, True, status, S.SESSION_END_TEXT
            else:
                n, status = n + 1, "exchange"
                ended = ends = 2 * n >= self.max_turns
                reason = "limit" if ends else None
                response = None if answer is None else answer + (S.SESSION_LIMIT_TEXT if ends else "")
                log.append((seq, text, response, ends))
            out.append((key[0], ts, seq, status, ends, response))
        self.session.update((n, ended, reason))
        if log:
            self.log.appendList(log)
        return self._frame(out)

    def idle(self, key, at):
        n, ended, _ = self.session.get()
        if ended:
            return None
        self.session.update((n, True, "timeout"))
        return self._frame([(key[0], at, None, "timeout", True, None)])

    def forget(self):
        self.session.clear()
        self.log.clear()


class _Memory(_InOrder):
    """State: the last non-empty value of every slot."""

    def __init__(self, key: str, order: str, slots: Sequence[str], idle_ms: int):
        super().__init__(["ts_ms", order, *slots], ", ".join([f"ts_ms long, {order} long", *[f"{s} string" for s in slots]]),
                         idle_ms, 0)
        self.key, self.order, self.slots = key, order, list(slots)

    def init(self, handle):
        super().init(handle)
        self.memory = handle.getValueState("memory", ", ".join(f"{s} string" for s in self.slots))

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=[self.key, "ts_ms", self.order, "late", *self.slots])

    def late_rows(self, key, rows):
        return self._frame([(key[0], r[0], r[1], True, *r[2:]) for r in rows])

    def fold(self, key, rows):
        memory = list(self.memory.get()) if self.memory.exists() else [None] * len(self.slots)
        out = []
        for ts, order, *values in rows:
            memory = [v or m for v, m in zip(values, memory)]
            out.append((key[0], ts, order, False, *memory))
        self.memory.update(tuple(memory))
        return self._frame(out)

    def idle(self, key, at):
        return None

    def forget(self):
        self.memory.clear()


def _timed(inputs: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``inputs`` with the watermark and ``ts_ms`` in place of the event time. The stateful operator reads the plain
    number, so that it sees late rows, which Spark would drop by a watermarked column."""
    return inputs.withWatermark(ts, lateness).withColumn("ts_ms", F.unix_millis(F.col(ts).cast("timestamp"))).drop(ts)


def _needs_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"timers need the RocksDB state store: set {PROVIDER} (use_rocksdb) before the stream starts")


def session_events(inputs: DataFrame, max_turns: int = S.MAX_SESSION_TURNS, lateness: str = "10 minutes",
                   idle_ms: int = HOUR_MS, tombstone_ms: int = HOUR_MS, key: str = "session_id", ts: str = "ts",
                   seq: str = "seq", text: str = "input_text", answer: str = "answer") -> DataFrame:
    """``session_id, ts_ms, seq, status, ends_session, response`` of a stream of session inputs in any order.

    Statuses are those of ``operators.sessions.session_fold`` over (ts, seq), 'late', and 'timeout' (one row
    without seq when an open session has been idle for ``idle_ms``)."""
    _needs_rocksdb(inputs.sparkSession)
    rows = _timed(inputs.select(F.col(key).cast("long").alias("session_id"), F.col(ts), F.col(seq).cast("long").alias("seq"),
                                F.col(text).alias("input_text"), F.col(answer).cast("string").alias("answer")), ts, lateness)
    return rows.groupBy("session_id").transformWithStateInPandas(
        _Sessions(max_turns, idle_ms, tombstone_ms),
        "session_id long, ts_ms long, seq long, status string, ends_session boolean, response string", "append", "EventTime")


def slot_memory_events(updates: DataFrame, key: str, ts: str, order: str, slots: Sequence[str], lateness: str = "10 minutes",
                       idle_ms: int = 24 * HOUR_MS) -> DataFrame:
    """Carry-forward over a stream in any order: ``key, ts_ms, order, late, slots...``, the memory after each update in
    the order (ts, order). A late row comes out with its own values. A key idle for ``idle_ms`` is forgotten."""
    _needs_rocksdb(updates.sparkSession)
    rows = _timed(updates.select(F.col(key).cast("long").alias(key), F.col(ts), F.col(order).cast("long").alias(order),
                                 *[F.col(s).cast("string").alias(s) for s in slots]), ts, lateness)
    columns = ", ".join([f"{key} long, ts_ms long, {order} long, late boolean", *[f"{s} string" for s in slots]])
    return rows.groupBy(key).transformWithStateInPandas(_Memory(key, order, slots, idle_ms), columns, "append", "EventTime")


def late_rows(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A micro-batch of ``session_events`` as (folded rows, late rows), for the two sinks of a ``foreachBatch``."""
    late = F.col("status") == "late"
    return batch.filter(~late), batch.filter(late)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def held_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``session_id, n_exchanges, ended, end_reason`` of the sessions in the state of a ``session_events`` query."""
    return _state(spark, checkpoint, "session").select(F.col("key.session_id").alias("session_id"), "value.*")


def held_logs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``session_id, log`` (exchanges in order) of the sessions in the state of a ``session_events`` query."""
    rows = _state(spark, checkpoint, "log")
    entry = "list_element" if "list_element" in rows.columns else "value"
    return (rows.groupBy(F.col("key.session_id").alias("session_id"))
            .agg(F.array_sort(F.collect_list(entry)).alias("log")))  # bounded by the turn limit


def unfinished_sessions(spark: SparkSession, checkpoint: str, scores: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions of the state that have no scores, with their logs: what an export of open sessions holds."""
    s = held_sessions(spark, checkpoint).join(scores.select(F.col(key).alias("session_id")).distinct(), "session_id", "left_anti")
    return s.join(held_logs(spark, checkpoint), "session_id", "left")
