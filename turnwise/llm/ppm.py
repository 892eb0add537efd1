"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``ORDER`` symbols, with counts from the training texts. A
text is its lower-cased (A-Z) UTF-8 bytes and an end symbol; before its first byte stand start symbols,
so that every position has a context of full length. The code length of a text is pretrained: its
own symbols do not change the counts. A symbol's probability:

* The longest context that occurs in training is asked first. With T occurrences and D distinct symbols
  after it, a symbol seen n times there has n / (T + D), and the escape has D / (T + D) (method C).
* After an escape the next shorter context is asked, without the symbols that the longer one knows
  (symbol exclusion): T and D count the other symbols only. If it knows no other symbol, the escape is certain.
* Below the empty context all symbols (256 bytes and the end) that it does not know are equally likely.

All symbols of a context are symbols of its shorter ones, so what is excluded depends on the longer
context alone, and one number per (context, symbol) holds the whole chain. How it runs:

1. Texts are dealt into blocks of at most ``BLOCK_BYTES``, written once. Each block gives out its distinct
   (context, symbol) pairs and its distinct words, with their counts in training texts.
2. Counts are added up per pair; shorter contexts follow from longer ones by dropping the oldest symbol.
   From the empty context upward, each order takes counts and escape sums from the order below by a
   join, so the trie is a set of tables that grow with the corpus and no task holds it whole.
3. The pairs that most blocks ask for, at most ``HEAD``, are broadcast. The values of a block's other pairs and
   of its words come back to it by a join; the block and its values meet in one cogroup, where numpy
   looks up every position.

The base score takes the words' training counts the same way, by a sum over each word's blocks. Pairs are
told apart exactly by non-negative 64-bit keys, words by digests of 63 bits in negative keys (two of a billion
words share one with a chance of 5 %).

Edge cases: null text counts as empty, which has the end symbol and one token; a null id counts as the
empty string (held out); repeated rows count and are scored each; without a training text all symbols
are equally likely and the counts are 0; an empty table gives an empty result; columns beyond id and
text are not read. A text is held whole by one task; a block holds at least one text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import Spans, words
from ..operators.joins import planned_bytes
from ..session import ensure_checkpoint_dir
from .common import documents, materialize, row_slices, small_batches, text_buffer
from .registry import register

ORDER = 5
BLOCK_BYTES, TASK_BYTES = 40 << 20, 24 << 20
SLICE = 1 << 20
HEAD = 500_000
SYMBOLS, START, END = 257, 256, 256   # the start only stands in contexts, the end only after them
BITS = 9
END_WORD = -1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_buffer(col)
    return _LOWER[data], off


def pairs(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every position, the newest symbol in the lowest bits, and each row's first position."""
    at = off + order * np.arange(len(off)) + np.arange(len(off))  # order starts and one end per row
    flat = np.full(int(at[-1]) + order, START, np.int64)
    size = np.diff(off)
    flat[np.arange(len(data)) + np.repeat(at[:-1] - off[:-1], size) + order] = data
    key = flat[order:].copy()
    for k in range(1, order + 1):
        key |= flat[order - k:len(flat) - k] << (BITS * k)
    inside = np.ones(len(key), bool)  # no position of a row's starts
    if order and len(size) > 1:
        inside[(at[1:-1, None] - order + np.arange(order)).ravel()] = False
    first = off + np.arange(len(off))
    return key[:first[-1]] if order == 0 else key[inside][:first[-1]], first


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every word, and each row's first word."""
    start, end, first = words(data, off)
    digest = Spans(data).digest(start, end).view(np.int64) if len(start) else np.zeros(0, np.int64)
    key = digest | np.int64(-1 << 63)
    key[key == END_WORD] = END_WORD - 1  # the end token's key is its own
    return key, first


def _written(df: DataFrame) -> DataFrame:
    """``materialize`` with more compression, for the large tables of a run."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ppm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``block, id, text, held_out`` of all rows, written; a block is a run of rows of one task. Scan tasks of
    less than ``TASK_BYTES`` are put together, as few large blocks ask for fewer values than many small ones."""
    kind = df.schema[id_col].dataType.simpleString()
    out = held_out(F.col(id_col))
    size = planned_bytes(df)
    df = df.select(id_col, text_col)
    df = df.coalesce(max(1, min(df.rdd.getNumPartitions(), -(-size // TASK_BYTES))))

    def run(batches):
        block, held = TaskContext.get().partitionId() << 31, 0
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for i, j in row_slices(off, SLICE):
                rows = batch.slice(i, j - i)
                if held and held + off[j] - off[i] > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += int(off[j] - off[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block)), *rows.columns],
                                                 ["block", "id", "text", "held_out"])
    return _written(df.withColumn("_held_out", out).mapInArrow(
        run, f"block bigint, id {kind}, text string, held_out boolean"))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class _Counts:
    """Distinct keys and the sums of their counts, gathered piece by piece."""

    def __init__(self):
        self.parts, self.held, self.most = [], 0, SLICE

    def add(self, key: np.ndarray, trained: np.ndarray) -> None:
        each, n = np.unique(key[trained], return_counts=True)
        other = np.unique(key[~trained])
        self.parts += [(each, n), (other, np.zeros(len(other), np.int64))]
        self.held += len(each) + len(other)
        if self.held > self.most:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])
            self.most = max(SLICE, 2 * self.held)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat(n, first) if len(first) else n


def wanted(dealt: DataFrame, order: int = ORDER) -> DataFrame:
    """``block, key, n``: the distinct pairs and words of each block, and how often training texts have them.
    A block that is read in several pieces has several rows for a key."""
    def give(block, found):
        key, n = found.total()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(n)],
                                         ["block", "key", "n"])

    def run(batches):
        block, found = None, None
        for batch in batches:
            which = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(which)) + 1
            for i, j in zip([0, *edges], [*edges, len(which)]):
                if i == j:
                    continue
                if which[i] != block:
                    if found:
                        yield from give(block, found)
                    block, found = int(which[i]), _Counts()
                part = batch.slice(i, j - i)
                data, off = _lowered(part.column(1))
                learn = ~np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
                for a, b in row_slices(off, SLICE):
                    d, o, y = data[off[a]:off[b]], off[a:b + 1] - off[a], learn[a:b]
                    for key, first in (tokens(d, o), pairs(d, o, order)):
                        found.add(key, np.repeat(y, np.diff(first)))
                    found.add(np.full(b - a, END_WORD), y)
        if found:
            yield from give(block, found)
    return _written(dealt.select("block", "text", "held_out").mapInArrow(run, "block bigint, key bigint, n bigint"))


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, value`` (log10 probability) for all ``key, n``: pairs of order ``order``; n is 0 for those
    that no training text has."""
    tables = [materialize(counts.select("key", "n"))]
    for j in range(order - 1, -1, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << BITS * (j + 1)) - 1))
        tables.insert(0, materialize(tables[0].groupBy(shorter.alias("key")).agg(F.sum("n").alias("n"))))
    context = F.shiftright("key", BITS)
    seen = F.col("n") > 0
    per = Window.partitionBy(context)  # at most SYMBOLS rows
    low = None
    for j, table in enumerate(tables):
        d = table
        if j:
            d = d.withColumn("low_key", F.col("key").bitwiseAND(F.lit((1 << BITS * j) - 1))).join(
                F.broadcast(low) if j == 1 else low, "low_key")  # order 0 has at most SYMBOLS rows
        # T, D: occurrences and distinct symbols of the context
        d = d.withColumn("T", F.sum("n").over(per)).withColumn("D", F.sum(seen.cast("long")).over(per))
        log = lambda x: F.log10(x.cast("double"))
        if j:
            # what the shorter context has beyond this one's symbols
            d = d.withColumn("X", F.sum(F.when(seen, F.col("low_n")).otherwise(0)).over(per))
            more = F.col("low_D") - F.col("D")
            total = F.col("low_T") - F.col("X") + more
            after = (F.when(F.col("low_n") > 0, log(F.col("low_n")) - log(total))
                     .when(more > 0, log(more) - log(total) + F.col("low_after")).otherwise(F.col("low_after")))
        else:
            after = -log(F.lit(SYMBOLS) - F.col("D"))
        # after: the symbol's log probability once this context has given it up
        d = d.withColumn("after", after)
        whole = log(F.col("T") + F.col("D"))
        top = F.when(seen, log(F.col("n")) - whole).when(F.col("T") > 0, log(F.col("D")) - whole + F.col("after"))
        top = top.otherwise(F.col("low_value") if j else -log(F.lit(SYMBOLS)))
        d = d.withColumn("value", top)
        if j == order:
            return d.select("key", "value")
        low = materialize(d.select(F.col("key").alias("low_key"), F.col("n").alias("low_n"), F.col("T").alias("low_T"),
                                   F.col("D").alias("low_D"), F.col("after").alias("low_after"),
                                   F.col("value").alias("low_value")))


class _Lookup:
    """Values of sorted distinct keys, found through a table of hashed places."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, first = np.unique(key[order], return_index=True)
        self.value = value[order][first]
        self.bits = max(8, int(len(self.key)).bit_length() + 2)
        self.place = np.zeros(1 << self.bits, np.int32)
        if len(self.key):
            self.place[self._hash(self.key)] = np.arange(len(self.key), dtype=np.int32)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(0)
        at = self.place[self._hash(key)]
        lost = np.flatnonzero(self.key[at] != key)
        at[lost] = np.searchsorted(self.key, key[lost])
        return self.value[at]


def _sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows' values."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(first[:-1] < first[1:])
    if len(some):
        out[some] = np.add.reduceat(value, first[:-1][some])
    return out


def most_asked(counts: DataFrame, head: int) -> DataFrame:
    """``key`` of the pairs that most blocks ask for: as many whole levels of ``asked`` as fit ``head`` rows."""
    levels = counts.filter("asked > 1").groupBy("asked").count()
    upto = F.sum("count").over(Window.orderBy(F.desc("asked")))  # one row per number of blocks
    least = levels.withColumn("upto", upto).filter(F.col("upto") <= head).agg(F.min("asked")).head()[0]
    return counts.filter(F.col("asked") >= least if least else F.lit(False)).select("key")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          head: int = HEAD) -> DataFrame:
    """One row per row of ``df``: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows that are not held out (``held_out``) and scores all."""
    if not 0 <= order <= 6:
        raise ValueError("a context and its symbol fit 64 bits up to order 6")
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    dealt = blocks(df, id_col, text_col)
    want = wanted(dealt, order)
    is_word = F.col("key") < 0
    pair, word = want.filter(~is_word), want.filter(is_word)
    counts = materialize(pair.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("asked")))
    lengths = materialize(code_lengths(counts, order))
    head = F.broadcast(materialize(most_asked(counts, head)))
    first = lengths.join(head, "key", "left_semi").toArrow()  # at most ``head`` rows
    known = spark.sparkContext.broadcast(tuple(first.column(c).to_numpy() for c in ("key", "value")))
    # a word has at most one row for each block and reading task
    of_word = Window.partitionBy("key")
    counted = _written(word.select("block", "key", F.sum("n").over(of_word).alias("c"),
                                   (F.row_number().over(of_word.orderBy("block")) == 1).alias("once")))
    n_all = word.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    distinct = counted.filter("once and c > 0").count()
    answers = (pair.select("block", "key").join(head, "key", "left_anti").join(lengths, "key").select("block", "key", "value")
               .unionByName(counted.select("block", "key", F.col("c").cast("double").alias("value"))))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        key, value = found.column("key").to_numpy(), found.column("value").to_numpy()
        mine = key >= 0
        word = _Lookup(key[~mine], value[~mine])
        pair = _Lookup(*(np.concatenate(x) for x in zip((key[mine], value[mine]), known.value)))
        end = word.of(np.full(1, END_WORD))[0]
        scale = n_all + 0.1 * (distinct + 1)
        out = []
        for batch in texts.to_batches():
            data, off = text_buffer(batch.column("text"))
            for i, j in row_slices(off, SLICE):
                d, o = _LOWER[data[off[i]:off[j]]], off[i:j + 1] - off[i]
                k, first = pairs(d, o, order)
                total = _sums(pair.of(k), first)
                t, first = tokens(d, o)
                c = word.of(t)
                base = _sums(np.log10((c + 0.1) / scale), first) + np.log10((end + 0.1) / scale)
                rows = batch.slice(i, j - i)
                out.append(pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("held_out"), pa.array(np.diff(first).astype(np.int64) + 1),
                     pa.array(_sums((c > 0).astype(float), first).astype(np.int64) + int(end > 0)),
                     pa.array(base), pa.array(total)],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out, schema=out[0].schema if out else None)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                         F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


@register("op13_ppm_score")
def op13_ppm_score(spark, sf_dir):
    return score(documents(spark, sf_dir))
