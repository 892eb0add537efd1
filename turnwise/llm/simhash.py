"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints are 64-bit SimHashes of the XXH64 values (seed 42) of word shingles. Two of them link at
``MAX_BITS`` = 3 or fewer differing bits. Links are found with a covering code:

* The fingerprint is cut into two halves. Of 3 differing bits at most 1 falls into one of the halves,
  so a link shows in a half at a threshold of 1 bit. Of each half the lower 31 bits are looked at.
* The anchors of a half are the words of the [31, 26] Hamming code, a covering code of radius 1: each
  31-bit word has an anchor within 1 bit.
* A fingerprint is replicated to every anchor within radius + threshold = 2 bits, which is 16 anchors
  a half (1 if it is an anchor itself). The anchor nearest to one end of a link is then an anchor of
  the other end as well, so each link meets at some anchor.
* Per anchor the whole fingerprints are compared by their bit distance. Members already joined are
  taken out of the comparison, so a dense family costs about its size, and no list of pairs is
  made: each task gives out a spanning forest of the links that it found.
* Members are counted per anchor before they are dealt. Those of an anchor with more than ``HOT_ANCHOR``
  are dealt by the pieces of the other half: 3 bits cannot touch all four bytes of it, so both ends of a
  link share one, and a hot anchor is spread over up to 1,024 groups. Within a task, groups of
  more than ``WALK`` are divided likewise by every three of six pieces of a half. Neither loses a link.

Equal fingerprints are one node from the start. Components come from large-star and small-star
rounds, each written to the checkpoint folder; each node ends at the smallest node of its component.
Joins on a node take nodes with more than 1 / ``HEAVY`` of all rows from a broadcast table (of fewer than
``HEAVY`` rows) and shuffle the others.

Edge cases: null and empty texts have fingerprint zero and link like any other; a text of fewer
words than a shingle is one shingle; repeated rows share a node; a null id is never a component's id
unless all ids are null; an empty table gives an empty result; columns beyond id and text are not
read. A text is held whole by one task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import documents, materialize, small_batches, text_buffer
from .registry import register

SHINGLE, MAX_BITS, SEED = 3, 3, 42
HALF_BITS = 31
HOT_ANCHOR, HEAVY = 10_000, 1_000
SMALL_GROUP, WALK = 24, 2_000
PIECES = ((0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 5))  # of a half: first bit and width
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    start = (end - sizes)[:len(words) - shingle + 1]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end[shingle - 1:].tolist())],
                      dtype=">u8").view(np.uint8).reshape(-1, 8)
    n = len(hashes)
    if n < 400:
        count = np.unpackbits(hashes, axis=1).sum(axis=0)
    else:
        count = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` (the 64 bits as a bigint) for every row."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            at = off.tolist()
            fp = [simhash(data[a:b].tobytes(), shingle) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint")


def _flip_masks() -> list[list[int]]:
    """For each syndrome of the Hamming code the bit flips that lead to its anchors, the nearest first."""
    out = [[0]]
    for s in range(1, HALF_BITS + 1):
        pairs = [(i, i ^ s) for i in range(1, HALF_BITS + 1) if i < i ^ s]
        out.append([1 << (s - 1)] + [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs])
    return out


def _syndrome(word: Column) -> Column:
    """Column i of the parity check is the number i: bit j of the syndrome is the parity of the bits with j in i."""
    out = F.lit(0)
    for j in range(5):
        members = sum(1 << (i - 1) for i in range(1, HALF_BITS + 1) if i >> j & 1)
        out = out + F.bit_count(word.bitwiseAND(F.lit(members))).bitwiseAND(F.lit(1)) * (1 << j)
    return out


def replicas(fps: DataFrame) -> DataFrame:
    """``anchor, fp``: every fingerprint at every anchor within 2 bits, in both halves."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for ms in _flip_masks()])
    low = F.lit((1 << HALF_BITS) - 1)
    halves = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseAND(low))
    words = fps.select("fp", F.posexplode(halves).alias("half", "word"))
    words = words.withColumn("masks", F.element_at(flips, _syndrome(F.col("word")) + 1))
    return words.select("fp", "half", "word", F.explode("masks").alias("mask")).select(
        (F.shiftleft(F.col("half").cast("long"), HALF_BITS) + F.col("word").bitwiseXOR(F.col("mask"))).alias("anchor"),
        "fp")


def dealt_replicas(fps: DataFrame) -> DataFrame:
    """``deal, fp``: the replicas by anchor; those of hot anchors once for each byte of the other half."""
    each = replicas(fps)
    hot = materialize(each.groupBy("anchor").count().filter(F.col("count") > HOT_ANCHOR).select("anchor"))
    if hot.isEmpty():
        return each.select(F.col("anchor").alias("deal"), "fp")
    table, _ = broadcast_if_small(hot.withColumn("hot", F.lit(True)))
    # an anchor of half 1 (the upper 32 bits) has bit HALF_BITS set: its members are dealt by the lower half
    shift = F.when(F.shiftright("anchor", HALF_BITS) == 0, 32).otherwise(0)
    other = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit((1 << 32) - 1))
    other = F.when(shift == 32, other).otherwise(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)))
    pieces = F.array(*[F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) + (k << 8) for k in range(4)])
    whole = F.array(F.lit(-1).cast("long"))
    named = each.join(table, "anchor", "left").select(
        "anchor", "fp", F.explode(F.when(F.col("hot"), pieces).otherwise(whole)).alias("piece"))
    # two groups that share a hash are compared as one, which finds no false link
    return named.select(F.xxhash64("anchor", "piece").alias("deal"), "fp")


def join_heavy(left: DataFrame, right: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """Inner join with ``right`` (one row per key, ``weight`` = rows of ``left`` with that key, ``total`` = rows of
    ``left``): heavy keys from a broadcast table, the others by a shuffle. Both are read twice."""
    heavy = F.col(weight) * HEAVY > total
    values = [c for c in right.columns if c not in (on, weight)]
    few = F.broadcast(right.filter(heavy).select(on, *values))
    rest = left.join(few.select(on), on, "left_anti").join(right.filter(~heavy).select(on, *values), on)
    return left.join(few, on).unionByName(rest)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _group_links(fp: np.ndarray, bits: int, level: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is within ``bits`` of each other, over any number of steps.

    A large group is divided by three pieces of the half in which it differs most, then of the other half:
    at most three of the six pieces hold differing bits, so the ends of a link are equal in some three."""
    if len(fp) <= WALK or level == 2:
        return _walk(fp, bits)
    halves = [(fp >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF) for k in (0, 1)]
    halves.sort(key=lambda h: -len(np.unique(h)))
    half, out = halves[level], []
    masks = [np.uint64(((1 << width) - 1) << at) for at, width in PIECES]
    for three in combinations(masks, 3):
        key = half & (three[0] | three[1] | three[2])
        order = np.argsort(key, kind="stable")
        out.append(anchor_links(key[order], fp[order], bits, level + 1))
    return out


def _walk(fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth first: each member is compared with those not yet joined; a joined one is taken out."""
    out, rest = [], fp
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = _near(rest, x, bits)
            if hit.any():
                found = rest[hit]
                out.append((np.full(len(found), x), found))
                front += list(found)
                rest = rest[~hit]
    return out


def anchor_links(anchor: np.ndarray, fp: np.ndarray, bits: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal ``anchor`` (sorted)."""
    edges = np.flatnonzero(np.diff(anchor)) + 1
    start = np.concatenate(([0], edges))
    size = np.diff(np.concatenate((start, [len(anchor)])))
    left, right = [], []
    room = np.repeat(start + size, size) - np.arange(len(anchor))  # members from here to the group's end
    live = np.flatnonzero((room > 1) & np.repeat(size <= SMALL_GROUP, size))
    k = 1
    while len(live):
        a, b = fp[live], fp[live + k]
        hit = _near(a, b, bits)
        left.append(a[hit])
        right.append(b[hit])
        k += 1
        live = live[room[live] > k]
    for i in np.flatnonzero(size > SMALL_GROUP):
        for a, b in _group_links(fp[start[i]:start[i] + size[i]], bits, level):
            left.append(a)
            right.append(b)
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


class Forest:
    """Union-find that tells whether a link joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that span the same components as all links at ``bits`` or fewer differing bits."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the covering holds for 0 to {MAX_BITS} bits")
    dealt = dealt_replicas(fps).repartition("deal").sortWithinPartitions("deal")

    def run(batches):
        forest = Forest()
        kept = []  # the pieces of the last group, which may go on in the next batch

        def forest_links(anchor, fp):
            a, b = anchor_links(anchor, fp, bits)
            if not len(a):
                return None
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).tolist()
            new = np.array([p for p in pairs if forest.join(*p)], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(new[:, 0].copy()), pa.array(new[:, 1].copy())], ["a", "b"])

        for batch in batches:
            deal, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(deal):
                continue
            if kept and deal[-1] == kept[0][0][0]:
                kept.append((deal, fp))
                continue
            last = int(np.searchsorted(deal, deal[-1]))
            kept.append((deal[:last], fp[:last]))
            if (out := forest_links(*(np.concatenate(x) for x in zip(*kept)))) is not None:
                yield out
            kept = [(deal[last:], fp[last:])]
        if kept and (out := forest_links(*(np.concatenate(x) for x in zip(*kept)))) is not None:
            yield out
    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node that has an edge, and the smallest node of its component."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state or now[0] == 0:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
        up = both.filter("v > u")
        large = join_heavy(up, low, "u", "n", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: id, ``fp``, ``component_id`` (smallest id reachable over links)."""
    docs = materialize(fingerprints(df, id_col, text_col, shingle))
    nodes = materialize(docs.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp"), bits))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    every = materialize(nodes.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("component_id", "first_id").alias("component_id")))
    return join_heavy(docs, every, "fp", "n", docs.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` whose id names their group; of repeated ids one row. Rows without id stay."""
    found = near_duplicates(df, id_col, text_col, shingle, bits)
    stay = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_stay")).distinct()
    one = Window.partitionBy(id_col).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    named = (df.join(stay, F.col(id_col) == F.col("_stay"), "left_semi")
             .withColumn("_first", F.row_number().over(one)).filter("_first = 1").drop("_first"))
    return named.unionByName(df.filter(F.col(id_col).isNull()))


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    d = near_duplicates(documents(spark, sf_dir))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
