"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a key draws -ln(u) / weight for every child, where u is a hash of the key and the child's
path, and goes to the child with the least draw. A child's chance is its share of the weights. Raising one
child's weight lowers only that child's draws, so rows move only into it; every other subtree keeps its
rows. A new shard opens a region of its own, so each row that moves lands in that shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedlens.llm.shared import saved

#: Buckets per shard in which rows are numbered; one task numbers a few buckets, never a whole shard.
BUCKETS = 512


@dataclass(frozen=True)
class Tree:
    """regions[g][r] is a tuple of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        new = 1 + max((s for region in self.regions for rack in region for s, _ in rack), default=-1)
        return Tree((*self.regions, (((new, weight),),)))


def even_tree(shards: int = 24, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards 0..shards-1 of equal weight, `per_rack` to a rack and `racks` racks to a region."""
    if shards < 1:
        raise ValueError("a tree needs one shard at least")
    rows = [tuple((s, 1.0) for s in range(a, min(a + per_rack, shards))) for a in range(0, shards, per_rack)]
    return Tree(tuple(tuple(rows[a : a + racks]) for a in range(0, len(rows), racks)))


def _draw(key: Column, path: str, weight: float) -> Column:
    """Exponential with rate `weight`; null keys draw as one more key."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _choose(draws: list[Column], values: list[Column]) -> Column:
    """The value with the least draw; of equal draws the first."""
    if len(values) == 1:
        return values[0]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(zip(draws, values, strict=True))]))["v"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: one weighted draw per child on the way down."""
    def weight(part) -> float:
        return float(part[1]) if isinstance(part[0], int) else sum(weight(x) for x in part)

    def down(part, path: str) -> Column:
        if isinstance(part[0], int):
            return F.lit(part[0])
        live = [(i, x) for i, x in enumerate(part) if weight(x) > 0]
        return _choose([_draw(key, f"{path}/{i}", weight(x)) for i, x in live], [down(x, f"{path}/{i}") for i, x in live])

    return down(tree.regions, "")


def numbered(rows: DataFrame, group: str, order: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with a number from 0, without gaps, inside each value of `group`.

    Rows are dealt to hash buckets, numbered there, and moved up by the sizes of the buckets before theirs.
    The table of sizes has `buckets` rows per group at most. Where a row stands in the input is part of its hash, so
    rows that repeat are dealt to all buckets; the saved table holds the bucket, so a repeated task numbers alike.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    rows = saved(rows, "shard-rows")
    sizes = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order)) - 1
    out = rows.withColumn("_inside", inside)
    return out.join(sizes, (out[group] == sizes["_group"]) & (out["_bucket"] == sizes["_of"])).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_of", "_group", "_before", "_inside")


def shard(docs: DataFrame, tree: Tree | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text has no bytes; a null doc_id is placed like any other key; repeated rows get one slot each.
    An empty table gives an empty result; other columns are ignored.
    """
    tree = tree or even_tree()
    key, text = F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree).cast("int").alias("shard"),
        place(key, tree.grown()).cast("int").alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
