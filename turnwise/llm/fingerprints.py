"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where the hash meets a mask. Chunking is
normalised: the strict mask counts between ``LEAST`` and ``NORMAL`` bytes, the loose one up to
``MOST`` bytes, where a chunk ends anyway. The hash sees ``GEAR_WINDOW`` bytes, which is no more than
``LEAST``, so a cut depends on the bytes of its chunk alone, and an insertion shifts cuts only until
the next content-defined one. The fingerprint is the set of the chunks' 48-bit digests, each weighted
by its length, written as ``digest:length`` in order and comma-joined. The likeness of a
fingerprint A to B is the containment: the weight of A's chunks that B has, over the weight of A.

``next_documents`` puts the next document by descending id beside each one. Ids are dealt to ranges
by quantiles (a list of at most ``MAX_BLOCKS`` numbers), the first document of each range is also
sent to the range before it, and a window inside each range does the rest; texts are shuffled once.

Edge cases: null text counts as empty; the empty text has the empty fingerprint, whose likeness is 1
to the empty fingerprint and 0 to any other; equal texts have equal fingerprints; repeated ids are
ordered by text; null ids come last; the only document is its own next one; an empty table gives an
empty result; columns beyond id and text are not read. A text is held whole by one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import GEAR_WINDOW, Spans, gear
from .common import documents, row_slices, small_batches, text_buffer
from .registry import register

LEAST, NORMAL, MOST = 16, 32, 128
STRICT, LOOSE = np.uint32(0x3F << 20), np.uint32(0x0F << 20)
DIGEST_BITS = 48
ROWS_PER_BLOCK, MAX_BLOCKS = 2_000, 100_000
assert LEAST >= GEAR_WINDOW


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and for each row the index of its first chunk (rows + 1 numbers)."""
    h = gear(data)
    loose_at = np.flatnonzero((h & LOOSE) == 0)
    strict = loose_at[(h[loose_at] & STRICT) == 0].tolist()
    loose = loose_at.tolist()
    strict.append(len(data) + MOST)
    loose.append(len(data) + MOST)
    ends: list[int] = []
    first = [0]
    a = b = 0
    bounds = off.tolist()
    for row_start, row_end in zip(bounds, bounds[1:]):
        s = row_start
        while row_end - s > LEAST:
            a = bisect_left(strict, s + LEAST - 1, a)
            cut = strict[a] + 1
            if cut > s + NORMAL:
                b = bisect_left(loose, s + NORMAL, b)
                cut = min(loose[b] + 1, s + MOST)
            s = min(cut, row_end)
            ends.append(s)
        if s < row_end:
            ends.append(row_end)
        first.append(len(ends))
    return np.asarray(ends, np.int64), np.asarray(first, np.int64)


def chunk_sets(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct chunk digests in order, and their lengths."""
    ends, first = cuts(data, off)
    if not len(ends):
        for _ in range(len(off) - 1):
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    filled = first[:-1] < first[1:]
    starts[first[:-1][filled]] = off[:-1][filled]
    digests = Spans(data).digest(starts, ends) >> np.uint64(64 - DIGEST_BITS)
    lengths = ends - starts
    # order all chunks by (row, digest) at once, then keep the first of equal ones
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.lexsort((digests, row))
    digests, lengths, row = digests[order], lengths[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (digests[1:] != digests[:-1]) | (row[1:] != row[:-1])
    digests, lengths, row = digests[fresh], lengths[fresh], row[fresh]
    at = np.searchsorted(row, np.arange(len(off)))
    for i in range(len(off) - 1):
        yield digests[at[i]:at[i + 1]], lengths[at[i]:at[i + 1]]


def written(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    digits = DIGEST_BITS // 4
    return ",".join(f"{d:0{digits}x}:{n}" for d, n in zip(chunks[0].tolist(), chunks[1].tolist()))


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weight of the chunks of ``a`` that ``b`` has, over the weight of ``a``."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return float(a[1][b[0][at] == a[0]].sum() / a[1].sum())


def _chunked(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, off = text_buffer(col)
    for i, j in row_slices(off):
        yield from chunk_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, weight`` (bytes in distinct chunks) for every row of ``df``."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = list(_chunked(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([written(c) for c in sets], pa.string()),
                 pa.array([int(c[1].sum()) for c in sets], pa.int64())], [id_col, "fingerprint", "weight"])
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string, weight bigint")


def next_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, next_text``: beside each document the text of the next one by descending id."""
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = df.count()
    blocks = max(1, min(MAX_BLOCKS, rows // ROWS_PER_BLOCK))
    bounds = df.agg(F.percentile_approx(id_col, [i / blocks for i in range(1, blocks)] or [0.5], 10 * MAX_BLOCKS)
                    ).head()[0] if blocks > 1 else []
    bounds = np.unique(np.asarray(bounds or [], np.int64))

    @F.pandas_udf("int")
    def block(ids):
        import pandas as pd
        # descending: the largest ids are in block 0; null ids are with the smallest
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).astype("int64"))
        return pd.Series(at.astype("int32"))

    d = d.withColumn("block", block("id") if len(bounds) else F.lit(0))
    heads = d.groupBy("block").agg(F.max("id").alias("head"))
    before = Window.orderBy("block")  # at most MAX_BLOCKS rows, one per range
    heads = heads.select("head", F.coalesce(F.lag("block").over(before), F.max("block").over(
        before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("goes_to"))
    sent = d.join(F.broadcast(heads), d["id"].eqNullSafe(heads["head"])).select(
        "id", "text", F.col("goes_to").alias("block"), F.lit(True).alias("sent"))
    order = Window.partitionBy("block").orderBy("sent", F.col("id").desc_nulls_last(), "text")
    both = d.withColumn("sent", F.lit(False)).unionByName(sent)
    return (both.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("sent"))
            .select(F.col("id").alias(id_col), "text", "next_text"))


def compare_edits(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For ``id, text, edited, next_text, ...``: the fingerprints and the likeness of text to the other two."""
    small_batches(pairs.sparkSession)
    plain = [f for f in pairs.schema.fields if f.name not in ("text", "edited", "next_text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + [
        "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"])

    def run(batches):
        for batch in batches:
            own = list(_chunked(batch.column("text")))
            edited = list(_chunked(batch.column("edited")))
            # the next document is mostly the row that follows; only the others are chunked once more
            follows = batch.column("text").slice(1)
            same = np.zeros(batch.num_rows, bool)
            same[:-1] = pa.compute.equal(batch.column("next_text").slice(0, batch.num_rows - 1), follows).to_numpy(
                zero_copy_only=False)
            rest = iter(list(_chunked(batch.column("next_text").filter(pa.array(~same)))))
            following = [own[i + 1] if same[i] else next(rest) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in plain] + [
                    pa.array([written(c) for c in own], pa.string()),
                    pa.array([written(c) for c in edited], pa.string()),
                    pa.array([containment(a, b) for a, b in zip(own, edited)], pa.float64()),
                    pa.array([containment(a, b) for a, b in zip(own, following)], pa.float64())],
                [f.name for f in plain] + ["fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return pairs.mapInArrow(run, schema)


@register("op10_document_fingerprints")
def op10_document_fingerprints(spark, sf_dir):
    d = next_documents(documents(spark, sf_dir))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (n - half).cast("int")), F.col("next_text").substr(F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    d = d.withColumn("edited_sha256", F.sha2("edited", 256))
    return compare_edits(d).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                   "near_edited", "near_next")
