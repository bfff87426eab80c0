"""Hierarchical weighted hash tree: region, rack, shard.

A document descends the tree. At each node every child draws an exponential
variable from a hash of (doc_id, child), divided by the child's weight, which
is the sum of those below it; the smallest draw wins, so children are chosen in
proportion to their weights. Only the children of the chosen node are hashed: a
draw for each region, then for each rack of one region, then for each shard of
one rack. A changed weight changes the draws of the subtrees that contain it
and of no others: rows move only into subtrees that grew and out of those that
shrank. `grown` adds a shard as a region of its own, the one subtree whose
weight changes, so that the new shard takes rows only into itself.

Law: `key`. Stored rows have numbers; the slot is the row's gapless number in
its shard by (bucket of the number, number); numbering runs per (shard,
bucket), and the buckets' offsets come from their counts, so no task holds a
shard, not even if all rows have one id.

Nulls: a null doc_id hashes as the word "null"; a null text has size 1 and the
CRC of no bytes. Equal rows get different slots and, as the key decides, the
same shard. Very long texts are measured whole. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, pick, shuffle_width, table

#: region -> rack -> {shard: weight}; 16 equal shards.
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(n_shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards 0..n-1 of weight 1 filled rack by rack."""
    tree: Tree = {}
    for s in range(n_shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree) -> Tree:
    """The tree with one more shard of weight 1, in a region of its own."""
    shards = [s for racks in tree.values() for rack in racks.values() for s in rack]
    return tree | {f"region{len(tree)}": {f"rack{sum(map(len, tree.values()))}": {max(shards, default=-1) + 1: 1.0}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def _choose(key: Column, weights: dict) -> Column:
    """The name of the child with the smallest draw; children without weight take nothing."""
    draws = [F.struct(_draw(key, str(n), w).alias("d"), F.lit(n).alias("n")) for n, w in weights.items() if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["n"]


def descend(rows: DataFrame, key: Column, tree: Tree) -> DataFrame:
    """rows plus region, rack and shard that the key reaches, level by level."""
    weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    live = {r: racks for r, racks in weight.items() if sum(racks.values()) > 0}

    def among(column: str, options: dict[str, Column]) -> Column:
        out = None
        for name, choice in options.items():
            here = F.col(column) == name
            out = F.when(here, choice) if out is None else out.when(here, choice)
        return out

    rows = rows.withColumn("region", _choose(key, {r: sum(racks.values()) for r, racks in live.items()}))
    rows = rows.withColumn("rack", among("region", {r: _choose(key, racks) for r, racks in live.items()}))
    return rows.withColumn("shard", among("rack", {k: _choose(key, tree[r][k]) for r, racks in live.items() for k, w in racks.items() if w > 0}))


def assign(docs: DataFrame, tree: Tree, other: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and, with a second tree, the shard there as grown_shard. Names of nodes are unique in a tree."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = rows.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    if other:
        rows = descend(rows, key, other).drop("region", "rack").withColumnRenamed("shard", "grown_shard")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = materialize(descend(rows, key, tree).withColumn("row", F.monotonically_increasing_id()), "shards")
    buckets = max(8, shuffle_width(spark))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("bucket")
    offsets = counts.select("shard", "bucket", (F.sum("n").over(w) - F.col("n")).alias("base"))
    own = Window.partitionBy("shard", "bucket").orderBy("row")
    placed = rows.withColumn("place", F.row_number().over(own) - 1).join(offsets, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "region", "rack", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    tree = even_tree(16)
    got = assign(table(spark, sf_dir, "documents"), tree, grown(tree))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
