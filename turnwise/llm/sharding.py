"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A row descends the tree. At each level every child draws an exponential number from a hash of the
row's key and the child's name, with the child's weight as rate; the smallest draw wins, so a
child is taken in proportion to its weight, and a change of one weight moves rows only into or
out of that child. Weight that is added later is a layer of its own: a grown shard adds its weight
under a new generation to its rack and region, these layers compete with the layers already there,
and a row that follows a grown layer at one level follows it down to the grown shard. So growth
moves rows only into the new shard (law ``key``), whatever rack it joins, while each level costs
one draw per child instead of one per leaf.

Slots number the rows of a shard without gaps: rows are dealt to ``SLOT_BUCKETS`` hash buckets per
shard, numbered inside each bucket, and shifted by the bucket's offset (a table of
shards x buckets rows, bounded by these two parameters, so it is broadcast).

Only DataFrame functions are used.

Edge cases: null text has size 1 and CRC 0; a null key hashes like a missing one and all such rows
share a shard; repeated rows share a shard and get slots of their own; an empty table gives an
empty result; columns beyond key and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize
from .registry import register

SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    generation: int = 0


@dataclass(frozen=True)
class Topology:
    """Leaves of the tree. Generation 0 is the tree as first built; growth adds generations."""

    leaves: tuple[Leaf, ...]

    @staticmethod
    def grid(regions: int, racks: int, shards: int) -> Topology:
        """An even tree; shards are numbered from 0 in tree order."""
        return Topology(tuple(
            Leaf(r, r * racks + k, (r * racks + k) * shards + s)
            for r in range(regions) for k in range(racks) for s in range(shards)))

    def grow(self, weight: float = 1.0) -> Topology:
        """The same tree with one more shard, in the rack that has least weight."""
        racks: dict[tuple[int, int], float] = {}
        for x in self.leaves:
            racks[x.region, x.rack] = racks.get((x.region, x.rack), 0.0) + x.weight
        region, rack = min(racks, key=lambda k: (racks[k], k))
        return Topology((*self.leaves, Leaf(region, rack, max(x.shard for x in self.leaves) + 1, weight,
                                            max(x.generation for x in self.leaves) + 1)))


def _uniform(key: list[Column], name: str) -> Column:
    """A number strictly between 0 and 1 from 53 bits of the hash of key and name."""
    h = F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def _draw(key: list[Column], layers: list[tuple[str, int, int, float]]) -> Column:
    """Winner ``struct(draw, node, generation)`` among weighted layers ``(level, node, generation, weight)``."""
    races = [F.struct((-F.log(_uniform(key, f"{level}:{node}:{gen}")) / w).alias("draw"),
                      F.lit(node).alias("node"), F.lit(gen).alias("generation"))
             for level, node, gen, w in layers]
    return races[0] if len(races) == 1 else F.least(*races)


def _cases(by: Column, branches: dict[int, Column]) -> Column:
    out = None
    for value, col in branches.items():
        out = F.when(by == value, col) if out is None else out.when(by == value, col)
    return out


def place(df: DataFrame, key: list[str], topology: Topology, prefix: str = "") -> DataFrame:
    """``df`` with ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard`` (int)."""
    cols = [F.col(k) for k in key]
    leaves = [x for x in topology.leaves if x.weight > 0]
    regions: dict[tuple[int, int], float] = {}
    for x in leaves:
        regions[x.region, x.generation] = regions.get((x.region, x.generation), 0.0) + x.weight
    base = [x for x in leaves if x.generation == 0]
    by_region = {r: [x for x in base if x.region == r] for r in {x.region for x in base}}
    by_rack = {k: [x for x in base if x.rack == k] for k in {x.rack for x in base}}
    grown = {x.generation: x for x in leaves if x.generation > 0}

    df = df.withColumn("_region", _draw(cols, [("region", r, g, w) for (r, g), w in sorted(regions.items())]))
    rack_draws = {}
    for r, xs in sorted(by_region.items()):
        weight: dict[int, float] = {}
        for x in xs:
            weight[x.rack] = weight.get(x.rack, 0.0) + x.weight
        rack_draws[r] = _draw(cols, [("rack", k, 0, w) for k, w in sorted(weight.items())])["node"]
    gen = F.col("_region.generation")
    rack = F.when(gen == 0, _cases(F.col("_region.node"), rack_draws))
    for g, x in sorted(grown.items()):
        rack = rack.when(gen == g, F.lit(x.rack))
    df = df.withColumn("_rack", rack)
    shard_draws = {k: _draw(cols, [("shard", x.shard, 0, x.weight) for x in xs])["node"]
                   for k, xs in sorted(by_rack.items())}
    shard = F.when(gen == 0, _cases(F.col("_rack"), shard_draws))
    for g, x in sorted(grown.items()):
        shard = shard.when(gen == g, F.lit(x.shard))
    return (df.withColumns({f"{prefix}region": F.col("_region.node").cast("int"),
                            f"{prefix}rack": F.col("_rack").cast("int"),
                            f"{prefix}shard": shard.cast("int")})
            .drop("_region", "_rack"))


def gapless_slots(df: DataFrame, shard_col: str, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without sending a shard to one task.

    ``df`` is read twice (bucket counts, then numbers), so pass a written table.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(SLOT_BUCKETS)).cast("int")
    b = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(shard_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(shard_col, "_bucket").orderBy(*order)
    return (b.withColumn("_at", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), [shard_col, "_bucket"])
            .withColumn(name, (F.col("_at") + F.col("_offset")).cast("long"))
            .drop("_bucket", "_at", "_offset"))


def shard_documents(df: DataFrame, topology: Topology, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size, text_crc32, region, rack, shard, grown_shard, slot``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                  F.crc32(text.cast("binary")).alias("text_crc32"))
    d = place(place(d, [id_col], topology), [id_col], topology.grow(), "grown_").drop("grown_region", "grown_rack")
    return gapless_slots(materialize(d), "shard", [id_col, "text_crc32", "size"])


@register("op5_sharding")
def op5_sharding(spark, sf_dir):
    d = shard_documents(documents(spark, sf_dir), Topology.grid(2, 2, 2))
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
                    "region", "rack")
