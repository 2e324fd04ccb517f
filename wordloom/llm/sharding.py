"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A row descends it: at each level every
child draws ``-ln(u) / weight``, with ``u`` from a hash of the child's path and
the row's key, and the smallest draw wins. A child's draw depends on nothing but
its own path, its weight and the key, so when weights change below some node,
rows move only into or out of that node's subtree. The tree grows by a new
region with one rack and one shard, so a new shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]
SHARDS, RACKS_A_REGION, SHARDS_A_RACK = 24, 2, 4
#: Rows of a shard are numbered in this many cells at once.
CELLS = 1024


def build_tree(shards: int = SHARDS, racks: int = RACKS_A_REGION, per_rack: int = SHARDS_A_RACK) -> Tree:
    """Equal weights; shards are numbered through racks, racks through regions."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(rack // racks, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and rack of its own."""
    racks = [rack for region in tree.values() for rack in region]
    shards = [s for region in tree.values() for rack in region.values() for s in rack]
    return tree | {max(tree) + 1: {max(racks) + 1: {max(shards) + 1: weight}}}


def _draw(path: str, weight: float, key: Column) -> Column:
    """Exponential with rate ``weight``; u from the upper 53 bits of the hash, never 0 or 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _winner(children: dict[int, tuple[str, float]], key: Column) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*[F.struct(_draw(path, w, key).alias("draw"), F.lit(i).alias("id")) for i, (path, w) in children.items()]))["id"]


def descend(tree: Tree, key: Column) -> list[tuple[str, Column]]:
    """Columns region, rack and shard, each in terms of the ones before it.

    Nodes of weight 0 get no rows. A null key is a key like any other.
    """
    heavy = {g: {r: {s: w for s, w in rack.items() if w > 0} for r, rack in region.items() if sum(rack.values()) > 0} for g, region in tree.items()}
    heavy = {g: region for g, region in heavy.items() if region}
    if not heavy:
        raise ValueError("a tree needs a shard of positive weight")
    region = _winner({g: (f"{g}", sum(sum(r.values()) for r in racks.values())) for g, racks in heavy.items()}, key)

    def by(parent: str, options: dict[int, Column]) -> Column:
        out = None
        for i, column in options.items():
            out = F.when(F.col(parent) == i, column) if out is None else out.when(F.col(parent) == i, column)
        return out

    rack = by("region", {g: _winner({r: (f"{g}/{r}", sum(shards.values())) for r, shards in racks.items()}, key) for g, racks in heavy.items()})
    shard = by("rack", {r: _winner({s: (f"{g}/{r}/{s}", w) for s, w in shards.items()}, key) for g, racks in heavy.items() for r, shards in racks.items()})
    return [("region", region), ("rack", rack), ("shard", shard)]


def assign(df: DataFrame, key: Column, tree: Tree) -> DataFrame:
    """``df`` with region, rack and shard; no row moves between partitions.

    Columns of those names are replaced. Empty input gives an empty result.
    """
    df = df.withColumn("__key", key)
    for name, column in descend(tree, F.col("__key")):
        df = df.withColumn(name, column)
    return df.drop("__key")


def numbered(df: DataFrame, scratch: Scratch, cells: int = CELLS) -> DataFrame:
    """``df``, which has shard, with slot: gapless from 0 in each shard, ties in any order.

    Rows are dealt to cells of a shard, cells are counted (one row for each task
    and cell is shuffled), and each cell starts where the ones before it end. No
    task holds a shard, and equal rows are spread over all cells.
    """
    df = df.withColumn("__row", F.monotonically_increasing_id())
    df = scratch.save(df.withColumn("__cell", F.pmod(F.xxhash64("__row"), F.lit(cells)).cast("int")), "assigned")
    before = W.partitionBy("shard").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy("shard", "__cell").count().select("shard", "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    at = F.row_number().over(W.partitionBy("shard", "__cell").orderBy("__row")) - 1
    return df.join(starts, ["shard", "__cell"]).withColumn("slot", (F.col("__start") + at).cast("long")).drop("__row", "__cell", "__start")


def op3_sharding(spark, sf_dir) -> DataFrame:
    """All documents in shards 0 to 23 by law ``key``; grown_shard is the place among 25.

    A null text has no bytes (size 8, CRC 0); a null doc_id is one key; rows with
    the same doc_id share a shard and have slots of their own.
    """
    tree = build_tree()
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.col("doc_id")
    grown = assign(docs, key, grow(tree)).withColumnRenamed("shard", "grown_shard").drop("region", "rack")
    placed = numbered(assign(grown, key, tree), Scratch(spark, "op3"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"), F.col("region").cast("int"), F.col("rack").cast("int"))
