"""One large JSON object ``{name: value, ...}`` read by many tasks.

Spark's text reader splits the file by bytes, with "}" as the end of a record, so any reader that Spark has will
do. Where a split begins it is not known whether a string is open or how deep the nesting is:

1. Every split is scanned under both assumptions (string closed, string open at its start) and gives out, for each,
   whether a string is open at its end and by how much the depth changed. A split begins after a "}", so no
   escape reaches into it.
2. A prefix pass over these summaries (one row per split) settles the state that each split begins with.
3. Every split is scanned again with its true state. It cuts its text at the top-level commas and gives out
   pieces, numbered from 0 (the end of the entry that began before it), one per entry that it touches.
4. A prefix sum over the numbers of cuts gives every piece its entry; the pieces of an entry, in file order, are
   its text. The entry's number is its position in the file, whatever tasks read it.

An entry is held whole by one task, the file is not. Text beyond the object's end must be white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))


def _structure(data: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Per byte: outside of strings, the change of depth there; and whether a string is open at the end."""
    backslash = data == 92
    at = np.arange(len(data))
    run_start = np.maximum.accumulate(np.where(~backslash, at, -1))      # last byte that is no backslash
    before = np.concatenate([[0], (at - run_start)[:-1]]) if len(data) else at
    quote = (data == 34) & (before % 2 == 0)
    parity = (np.cumsum(quote) + int(in_string)) % 2 == 1
    outside = ~parity & ~quote
    step = np.where(outside, np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8), 0)
    return outside, step, bool(parity[-1]) if len(data) else in_string


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(split, index of the chunk in it, bytes), the "}" that ends each record put back."""
    split, n = None, 0
    for batch in batches:
        which, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if which[i] != split:
                split, n = int(which[i]), 0
            yield split, n, "".join([t + "}" for t in texts[i:j]]).encode()
            n += 1


def _summaries(batches):
    """Per chunk and assumption: state at the end and change of depth."""
    for split, n, raw in _splits(batches):
        data = np.frombuffer(raw, np.uint8)
        both = [_structure(data, assumed) for assumed in (False, True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([split] * 2), pa.array([n] * 2), pa.array([False, True]), pa.array([e for _, _, e in both]),
             pa.array([int(s.sum()) for _, s, _ in both])], ["split", "n", "assumed", "ends", "depth"])


def _settle(summaries: DataFrame) -> dict[tuple[int, int], tuple[bool, int]]:
    """The state (string open, depth) that each chunk begins with; one row per chunk and assumption."""
    rows = {(r["split"], r["n"], r["assumed"]): (r["ends"], r["depth"]) for r in summaries.collect()}
    state, out = (False, 0), {}
    for split, n in sorted({k[:2] for k in rows}):
        out[split, n] = state
        ends, depth = rows[split, n, state[0]]
        state = (ends, state[1] + depth)
    return out


def _pieces(batches, begins):
    """``split, n, cut, text``: the text between top-level commas; ``cut`` counts the commas of the chunk before it."""
    for split, n, raw in _splits(batches):
        in_string, depth = begins[split, n]
        data = np.frombuffer(raw, np.uint8)
        outside, step, _ = _structure(data, in_string)
        level = depth + np.cumsum(step)
        inside = (level >= 1) & ~((step == 1) & (level == 1))            # without the object's own braces
        comma = outside & (data == 44) & (level == 1)
        edges = [-1, *np.flatnonzero(comma).tolist(), len(data)]
        texts = []
        for a, b in zip(edges, edges[1:]):
            part = data[a + 1:b][inside[a + 1:b]]
            texts.append(part.tobytes())
        if edges == [-1, len(data)] and not texts[0]:
            continue
        yield pa.RecordBatch.from_arrays(
            [pa.array([split] * len(texts)), pa.array([n] * len(texts)), pa.array(range(len(texts)), pa.int64()),
             pa.array(texts, pa.binary())], ["split", "n", "cut", "text"])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``file_pos, entry`` of one file: the text of each ``"name": value`` at the top level, numbered in file order."""
    # plain scans: both passes see the same splits, and the rows of a split in order
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_block_start").alias("split"), "value")
    begins = spark.sparkContext.broadcast(_settle(lines.mapInArrow(
        _summaries, "split bigint, n bigint, assumed boolean, ends boolean, depth bigint")))
    pieces = lines.mapInArrow(lambda b: _pieces(b, begins.value), "split bigint, n bigint, cut bigint, text binary")
    # commas per chunk: one row each
    cuts = sorted((r["split"], r["n"], r["c"]) for r in pieces.groupBy("split", "n").agg(F.max("cut").alias("c")).collect())
    first, total = [], 0
    for split, n, c in cuts:
        first.append((split, n, total))
        total += c
    table = F.broadcast(spark.createDataFrame(first, "split bigint, n bigint, first bigint"))
    named = pieces.join(table, ["split", "n"]).select((F.col("first") + F.col("cut")).alias("file_pos"), "split", "n", "text")
    parts = F.array_sort(F.collect_list(F.struct("split", "n", F.hex("text").alias("x"))))  # the pieces of one entry
    whole = named.groupBy("file_pos").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("e"))
    return whole.select("file_pos", F.decode("e", "UTF-8").alias("entry")).filter(~F.col("entry").rlike(r"^\s*$"))


def read_keyed(spark: SparkSession, path: str, value_type) -> DataFrame:
    """``file_pos, name, value`` of one file, as ``from_json`` of the whole text gives them."""
    from pyspark.sql import types as T
    e = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), T.MapType(T.StringType(), value_type))
    return read_entries(spark, path).select("file_pos", F.explode(e).alias("name", "value"))
