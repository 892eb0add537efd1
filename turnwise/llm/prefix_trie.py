"""Conversation prefix trie by splitter skeleton.

A conversation's path is its turns in order, a block per turn: 16 bytes of the SHA-256 of role and
text, and the text's size. Each distinct prefix is a node. The trie is built in shards:

1. Paths are sorted by range partitioning on (path, conversation), so that copies of one path can
   lie in several shards, and written; shards hold about ``SHARD_BYTES``.
2. A node lies in two shards only if it is a prefix of the path that splits them: of the turns that
   the last path of one and the first path of the next have in common. The trie of these splitter
   paths is the skeleton (at most ``SKELETON_NODES`` nodes, else the paths are dealt into half as many
   shards); it is broadcast.
3. Each shard walks its sorted paths with a stack of the open nodes. Nodes outside the skeleton are
   finished there. For a skeleton node the shard gives out one partial aggregate: members, smallest
   member, children, leaves and savings below it that are finished, and the ids that end there.
4. Partial aggregates are added up per skeleton node; the sums of the skeleton go from its leaves to
   its root on the driver (numbers only). Ids that end at a skeleton node arrive as chunks in order
   and are hashed as a stream.

A node that hangs on a skeleton node gets its parent's smallest member by a broadcast join.

Edge cases: null role or text is empty; rows of a null conversation belong to no conversation and
are left out; turns that tie (null turns come first) are ordered by role, then by the digest of role
and text; repeated rows are turns of their own; a conversation without turns ends at the root; the
remainder of a negative conversation id has its sign (as in SQL); an empty table has no node; other
columns are not read. A conversation's path (24 bytes a turn) is held whole by one task, its texts
are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import planned_bytes
from .common import materialize
from .registry import register

BLOCK = 24
SHARD_BYTES = 8 << 20
SKELETON_NODES = 1_000_000
CHUNK_IDS = 2_000
OUT_ROWS = 5_000
GROUP, MOST_HEAD = 5, 9

NODE, PARTIAL, ENDS = 0, 1, 2
_SCHEMA = pa.schema([
    ("kind", pa.int8()), ("sid", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string()), ("shard", pa.int32()), ("seq", pa.int64())])
_DDL = ("kind tinyint, sid int, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, shard int, seq bigint")
OUTPUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_block(role: Column, text: Column) -> Column:
    """A turn as hex: digest of role and text, size of the text in bytes."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.upper(F.sha2(whole, 256)), 1, 32), F.lpad(F.hex(F.octet_length(text)), 16, "0"))


def _sorted_path(turns: DataFrame) -> Column:
    known = F.col("turn").isNotNull()
    rows = F.array_sort(F.collect_list(F.struct(known, F.coalesce("turn", F.lit(0)), "role", "block")))
    return F.unhex(F.array_join(F.transform(rows, lambda x: x["block"]), "")).alias("path")


def _turns(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_block(role, text).alias("block"))


def paths(df: DataFrame) -> DataFrame:
    """``conv_id, path`` of every conversation as it is."""
    t = _turns(df)
    return t.groupBy("conv_id").agg(_sorted_path(t))


def rebuilt_paths(df: DataFrame, group: int = GROUP, most_head: int = MOST_HEAD) -> DataFrame:
    """``conv_id, path`` with the head of each conversation taken from the first one of its group of ids.

    One shuffle, by group: conversations and then the few members of a group are aggregated where they lie."""
    t = _turns(df).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).repartition("base")
    own = t.groupBy("base", "conv_id").agg(_sorted_path(t))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("path", 1, (most_head - 1) * BLOCK)))
    each = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "path")).alias("members"), head.alias("head"))
    each = each.select(F.explode("members").alias("m"), F.coalesce("head", F.lit(b"")).alias("head"))
    h = (F.crc32(F.col("m.conv_id").cast("string").cast("binary")) % most_head * BLOCK).cast("int")
    path = F.col("m.path")
    return each.select("m.conv_id", F.concat(
        F.substring(F.col("head"), F.lit(1), h), F.substring(path, h + 1, F.length(path))).alias("path"))


def shared(a: bytes, b: bytes) -> int:
    """Number of leading blocks that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // BLOCK
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * BLOCK] == b[:mid * BLOCK]:
            low = mid
        else:
            high = mid - 1
    return low


class Skeleton:
    """The trie of the splitter paths: ids by splitter and depth, parents, sizes; the root is node 0."""

    def __init__(self, splitters: list[tuple[int, bytes]]):
        """``splitters``: (shard, turns that its first path shares with the last path of the shard before)."""
        self.parent, self.depth, self.size = [-1], [0], [0]
        self.at: dict[int, tuple[bytes, list[int]]] = {}
        before, ids = b"", [0]
        for shard, path in sorted(splitters):
            ids = ids[:shared(before, path) + 1]
            for d in range(len(ids), len(path) // BLOCK + 1):
                self.parent.append(ids[-1])
                self.depth.append(d)
                self.size.append(int.from_bytes(path[d * BLOCK - 8:d * BLOCK], "big"))
                ids.append(len(self.parent) - 1)
            self.at[shard] = (path, ids)
            before = path

    def of_shards(self, shards: list[int]) -> dict[int, list[tuple[bytes, list[int]]]]:
        """Per shard the splitters at its two ends."""
        root = (b"", [0])
        return {s: [self.at.get(s, root), self.at.get(after, root)] for s, after in zip(shards, [*shards[1:], -1])}


class _Open:
    """A node on the stack."""

    __slots__ = ("sid", "conv", "n", "children", "leaves", "saved", "ends", "ids", "pending", "seq")

    def __init__(self, sid):
        self.sid, self.conv, self.n, self.children, self.leaves, self.saved = sid, None, 0, 0, 0, 0
        self.ends, self.ids, self.pending, self.seq = None, [], [], 0


class _Walk:
    """The nodes of one shard from its sorted paths."""

    def __init__(self, shard: int, ends: list[tuple[bytes, list[int]]], out: list):
        self.shard, self.ends, self.out = shard, ends, out
        self.path, self.stack = b"", [_Open(0)]

    def add(self, conv: int, path: bytes) -> None:
        keep = shared(self.path, path)
        while len(self.stack) > keep + 1:
            self._close()
        sids = [0]
        for splitter, ids in self.ends:
            same = shared(splitter, path)
            if same >= len(sids):
                sids = ids[:same + 1]
        for d in range(len(self.stack), len(path) // BLOCK + 1):
            self.stack.append(_Open(sids[d] if d < len(sids) else None))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ids.append(conv)
        if len(node.ids) >= CHUNK_IDS:
            self._chunk(node)

    def _chunk(self, node: _Open) -> None:
        if not node.ids:
            return
        text = ",".join(map(str, node.ids))
        node.ids = []
        if node.sid is not None:
            self.out.append((ENDS, node.sid, None, None, None, None, None, None, None, text, self.shard, node.seq))
        else:
            node.ends = node.ends or hashlib.sha256()
            node.ends.update((("," if node.seq else "") + text).encode())
        node.seq += 1

    def _close(self) -> None:
        depth = len(self.stack) - 1
        node = self.stack.pop()
        self._chunk(node)
        if node.sid is None:
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * int.from_bytes(self.path[depth * BLOCK - 8:depth * BLOCK], "big")
            row = (node.conv, node.n, node.children, node.leaves, node.saved,
                   node.ends.hexdigest() if node.ends else _NOTHING)
            for x in node.pending:
                self._node(depth + 1, x, node.conv, None)
            up = self.stack[-1]
            up.children += 1
            if up.sid is None:
                up.pending.append(row)  # until the smallest member of the parent is known
            else:
                self._node(depth, row, None, up.sid)
        else:
            self.out.append((PARTIAL, node.sid, None, node.conv, None, node.n, node.children, node.leaves, node.saved,
                             None, None, None))
            if not depth:
                return
            up = self.stack[-1]
        up.n += node.n
        up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        up.leaves += node.leaves
        up.saved += node.saved

    def _node(self, depth, row, parent_conv, parent_sid) -> None:
        conv, n, children, leaves, saved, ends = row
        self.out.append((NODE, parent_sid, depth, conv, parent_conv, n, children, leaves, saved, ends, None, None))

    def end(self) -> None:
        while self.stack:
            self._close()


def _rows(out: list) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)]
    out.clear()
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def walk_shards(ranged: DataFrame, known: dict[int, list[tuple[bytes, list[int]]]]) -> DataFrame:
    """Finished nodes, partial aggregates and ends of all shards."""
    spark = ranged.sparkSession
    table = spark.sparkContext.broadcast(known)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(known))
    dealt = ranged.repartition(parts, "shard").sortWithinPartitions("shard", "path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]):
        out, walk = [], None
        for batch in batches:
            for shard, path, conv in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id"))):
                if walk is None or walk.shard != shard:
                    if walk:
                        walk.end()
                    walk = _Walk(shard, table.value[shard], out)
                walk.add(conv, path)
                if len(out) >= OUT_ROWS:
                    yield _rows(out)
        if walk:
            walk.end()
        while out:
            yield _rows(out)
    return dealt.select("shard", "path", "conv_id").mapInArrow(run, _DDL)


def splitters(ranged: DataFrame) -> DataFrame:
    """Per shard ``shard, path``: the leading turns that its first path shares with the last path of the shard before."""
    ends = materialize(ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    shards = [r[0] for r in ends.select("shard").orderBy("shard").collect()]
    spark = ranged.sparkSession
    after = spark.createDataFrame(list(zip(shards[1:], shards)) or [], "next int, shard int")
    pairs = (ends.select("shard", "last").join(F.broadcast(after), "shard")
             .join(ends.select(F.col("shard").alias("next"), "first"), "next").select("next", "last", "first"))

    def run(batches):
        for b in batches:
            both = [x[:shared(x, y) * BLOCK] for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both, pa.binary())], ["shard", "path"])
    only = spark.createDataFrame([(shards[0], b"")] if shards else [], "shard int, path binary")
    return only.unionByName(pairs.mapInArrow(run, "shard int, path binary"))


def ranged_paths(conversations: DataFrame, shards: int) -> DataFrame:
    """``shard, path, conv_id``: shards are ranges of (path, conv_id)."""
    return materialize(conversations.repartitionByRange(shards, "path", "conv_id")
                       .select(F.spark_partition_id().alias("shard"), "path", "conv_id"))


def _hash_ends(ends: DataFrame) -> DataFrame:
    """``sid, ends_sha256``: chunks of ids in order, hashed as they come."""
    dealt = ends.select("sid", "shard", "seq", "ends").repartition("sid").sortWithinPartitions("sid", "shard", "seq")

    def run(batches):
        sid, h = None, None
        for b in batches:
            found = []
            for s, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if s != sid:
                    if h:
                        found.append((sid, h.hexdigest()))
                    sid, h = s, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()),
                                              pa.array([x[1] for x in found], pa.string())], ["sid", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([sid], pa.int32()), pa.array([h.hexdigest()])],
                                             ["sid", "ends_sha256"])
    return dealt.mapInArrow(run, "sid int, ends_sha256 string")


def _reduce(partial: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """The skeleton's nodes from the sums of their partial aggregates: one row per node."""
    total = partial.groupBy("sid").agg(F.min("conv_id"), *[F.sum(c) for c in (
        "n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()  # at most SKELETON_NODES rows of numbers
    conv, n, children, leaves, saved = ([0] * len(skeleton.parent) for _ in range(5))
    for r in total:
        conv[r[0]], n[r[0]], children[r[0]], leaves[r[0]], saved[r[0]] = r[1:]
    for i in range(len(n) - 1, 0, -1):
        children[skeleton.parent[i]] += 1
    more_leaves, more_saved = [0] * len(n), [0] * len(n)
    for i in range(len(n) - 1, -1, -1):  # children come after their parents
        more_leaves[i] += not children[i]
        more_saved[i] += (n[i] - 1) * skeleton.size[i]
        if i:
            more_leaves[skeleton.parent[i]] += more_leaves[i]
            more_saved[skeleton.parent[i]] += more_saved[i]
    return [(i, conv[i], skeleton.depth[i], conv[skeleton.parent[i]] if i else None, n[i], children[i],
             leaves[i] + more_leaves[i], saved[i] + more_saved[i]) for i in range(len(n))]


def trie(conversations: DataFrame, shards: int | None = None, most: int = SKELETON_NODES) -> DataFrame:
    """The nodes (columns ``OUTPUT``) of the trie of ``conversations`` (conv_id, path; conv_id is unique)."""
    spark = conversations.sparkSession
    conversations = materialize(conversations)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                           planned_bytes(conversations) // SHARD_BYTES)
    while True:
        ranged = ranged_paths(conversations, shards)
        split = materialize(splitters(ranged))
        nodes = split.agg(F.sum(F.length("path"))).head()[0] or 0
        if nodes <= most * BLOCK or shards == 1:
            break
        shards = max(1, shards // 2)
    found = sorted((r["shard"], bytes(r["path"])) for r in split.collect())
    if not found:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in OUTPUT))
    skeleton = Skeleton(found)
    rows = materialize(walk_shards(ranged, skeleton.of_shards([s for s, _ in found])))
    top = spark.createDataFrame(
        _reduce(rows.filter(F.col("kind") == PARTIAL), skeleton),
        "sid int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint")
    ends = _hash_ends(rows.filter(F.col("kind") == ENDS))
    upper = top.join(ends, "sid", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    names = F.broadcast(top.select("sid", F.col("conv_id").alias("_above")))
    lower = (rows.filter(F.col("kind") == NODE).join(names, "sid", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
             .withColumnRenamed("ends", "ends_sha256"))
    return lower.select(*OUTPUT).unionByName(upper.select(*OUTPUT))


SQL = """
with t as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations
           where conv_id is not null),
orig as materialized (
  select c, list({'r': r, 'x': x} order by turn nulls first, r, sha256(strlen(r) || ':' || r || x)) as p from t group by c),
crc as (select c, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(
          string_split(cast(c as varchar), ''), lambda y: cast(ascii(y) as bigint))),
          lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                   lambda z, i: xor(z >> 1, cast(3988292384 as bigint) * (z & 1)))),
        4294967295) % 9 as h from orig),
rebuilt as materialized (
  select o.c, list_concat(list_slice(coalesce(b.p, []), 1, h), list_slice(o.p, h + 1, len(o.p))) as p
  from orig o join crc using (c) left join orig b on b.c = o.c - o.c % 5),
steps as (select c, len(p) as n, unnest(range(len(p) + 1)) as d, p from rebuilt),
nodes as materialized (
  select list_slice(p, 1, d) as k, d, min(c) as conv_id, count(*) as n_convs,
         string_agg(cast(c as varchar), ',' order by c) filter (n = d) as ends
  from steps group by 1, 2),
kids as (select list_slice(k, 1, d - 1) as k, count(*) as n_children from nodes where d > 0 group by 1),
full_nodes as materialized (
  select nodes.*, coalesce(n_children, 0) as n_children,
         case when d = 0 then 0 else (n_convs - 1) * strlen(k[d]['x']) end as saved
  from nodes left join kids using (k)),
sums as (
  select list_slice(k, 1, u) as k, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens
  from (select k, n_children, saved, unnest(range(d + 1)) as u from full_nodes) group by 1)
select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       cast(s.saved_tokens as bigint) as saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
from full_nodes f join sums s using (k)
left join nodes up on f.d > 0 and up.k = list_slice(f.k, 1, f.d - 1)
"""


@register("op12_prefix_trie", sql=SQL)
def op12_prefix_trie(spark, sf_dir):
    return trie(rebuilt_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
