"""Operator 9, sharding: a hierarchical weighted hash tree (region, rack, shard). DataFrame functions only.

A key descends from the root: at each level every child draws ``-ln(u) / weight`` with ``u`` a hash of
(seed, node, key) in (0, 1), and the smallest draw wins. A child's draw depends on nothing but its own name and
weight, so changing one child's weight moves keys only into or out of that child's subtree, in proportion.
A new shard is opened as a subtree of its own (its region's other children draw as before), so it alone gains.

Edge cases: a null key is hashed as the word ``null``; a null text has size 1 and the crc32 of no bytes (0); rows
that repeat a key share its shard and get slots of their own; an empty table gives an empty result; other columns
pass through unless they carry the name of an output column, in which case the output replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import materialize

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]


@dataclass(frozen=True)
class Topology:
    leaves: tuple[Leaf, ...]
    seed: str = "tree-1"

    @staticmethod
    def of(n_shards: int, racks_per_region: int = 2, shards_per_rack: int = 4, base: int = 16) -> Topology:
        """``base`` shards in full racks and regions; each later shard is a region of its own."""
        per_region = racks_per_region * shards_per_rack
        full = [(s // per_region, s // shards_per_rack, s, 1.0) for s in range(min(n_shards, base))]
        return Topology(tuple(full + [(1_000_000 + s, 1_000_000 + s, s, 1.0) for s in range(base, n_shards)]))

    def reweighted(self, shard: int, weight: float) -> Topology:
        return Topology(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.leaves), self.seed)

    def children(self, level: int, parent: tuple[int, ...]) -> dict[int, float]:
        sums: dict[int, float] = {}
        for leaf in self.leaves:
            if leaf[:level] == parent and leaf[3] > 0:
                sums[leaf[level]] = sums.get(leaf[level], 0.0) + leaf[3]
        return sums


def _draw(key: F.Column, seed: str, level: int, node: int, weight: float) -> F.Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|{level}|{node}|"), key).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return -F.log(u) / F.lit(float(weight))


def _winner(key: F.Column, topo: Topology, level: int, parent: tuple[int, ...]) -> F.Column:
    kids = sorted(topo.children(level, parent).items())
    if len(kids) == 1:
        return F.lit(kids[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, topo.seed, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in kids]))["n"]


def assign(df: DataFrame, key: str, topo: Topology, out: str = "shard") -> DataFrame:
    """Add the shard of each row; three projections, one for each level, and no shuffle."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, _winner(k, topo, 0, ()))
    regions = sorted(topo.children(0, ()))
    pick = F.lit(None).cast("int")
    for r in regions:
        pick = F.when(F.col(region) == r, _winner(k, topo, 1, (r,))).otherwise(pick)
    df = df.withColumn(rack, pick)
    pick = F.lit(None).cast("int")
    for r in regions:
        for c in sorted(topo.children(1, (r,))):
            pick = F.when((F.col(region) == r) & (F.col(rack) == c), _winner(k, topo, 2, (r, c))).otherwise(pick)
    return df.withColumn(out, pick.cast("int")).drop(region, rack)


def number_slots(df: DataFrame, shard: str, order: list[str], per_slice: int = 20_000, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard without sorting a shard in one task.

    The rows are written once with a draw from the order columns and their place, so that equal rows are drawn apart.
    Slices of a shard by that draw hold about ``per_slice`` rows; rows are numbered inside their slice and the slices'
    counts, one row each, give the offsets.
    """
    drawn = materialize(df.withColumn("__draw", F.xxhash64(*order, F.monotonically_increasing_id())), "drawn")
    most = drawn.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    rows = drawn.withColumn("__cut", F.pmod("__draw", F.lit(max(1, -(-most // per_slice)))).cast("int"))
    inner = rows.withColumn("__n", F.row_number().over(Window.partitionBy(shard, "__cut").orderBy("__draw")))
    counts = rows.groupBy(shard, "__cut").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(shard).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "__cut", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    return inner.join(offsets, [shard, "__cut"]).withColumn(out, (F.col("__before") + F.col("__n") - 1).cast("long")).drop("__draw", "__cut", "__n", "__before", "__c")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Shard, size, checksum and slot of every row, and its shard after one more is opened; texts are not shuffled."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    both = assign(assign(narrow, "doc_id", Topology.of(n_shards)), "doc_id", Topology.of(n_shards + 1), "grown_shard")
    return number_slots(both, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
