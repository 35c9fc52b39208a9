"""Sharding by a hierarchical weighted hash tree [native].

A document descends region, rack and shard levels. At every level each child draws
``-ln(u) / weight`` with ``u`` hashed from the document key and the child, and the smallest
draw wins, so a child is chosen with its share of the weight. Only children whose weight
changes can win or lose documents: movement stays inside those subtrees.

``grow`` adds a shard as a new region, the one change of the tree that leaves the weight of every
existing node as it is; documents then move into the new shard or stay. The tree of N shards is
a fixed base tree plus one region for each further shard, so the key and N decide the place.

Defined cases: a null key is one key like any other; a null text has no bytes; repeated rows keep
their shard and get slots of their own (in any order among identical rows); an empty table gives
an empty result; columns other than the key and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hash_bits, keep, running_offset


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` is the list of (shard, weight) of rack k in region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def shards(self) -> list[int]:
        return [s for racks in self.regions for rack in racks for s, _ in rack]


def base_tree(shards: int, racks_in_region: int = 5, shards_in_rack: int = 4) -> Tree:
    """Shards of weight 1, dealt to racks and regions in order."""
    every = [(s, 1.0) for s in range(shards)]
    racks = [tuple(every[i : i + shards_in_rack]) for i in range(0, shards, shards_in_rack)]
    return Tree(tuple(tuple(racks[i : i + racks_in_region]) for i in range(0, len(racks), racks_in_region)))


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region and rack of its own."""
    return Tree((*tree.regions, (((max(tree.shards, default=-1) + 1, weight),),)))


def _descend(level: str, parent: Column, weights: list[list[float]], key: list[Column]) -> Column:
    """Index of the winning child among the children of ``parent`` (0-based), by weighted draws."""
    widest = max(map(len, weights))
    flat = F.array(*[F.lit(float(w)) for row in weights for w in [*row, *[0.0] * (widest - len(row))]])
    draws = []
    for j in range(widest):
        hashed = F.xxhash64(*key, F.lit(level), parent, F.lit(j))
        u = (F.shiftrightunsigned(hashed, 11) + F.lit(0.5)) / F.lit(float(2**53))
        w = F.element_at(flat, parent * widest + j + 1)
        draws.append(F.struct(F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf"))).alias("draw"), F.lit(j).alias("child")))
    return draws[0]["child"] if widest == 1 else F.least(*draws)["child"]


def place(df: DataFrame, tree: Tree, key: list[str], out: str) -> DataFrame:
    """Add the shard of each row as ``out``."""
    keys = [F.col(c) for c in key]
    racks = [rack for region in tree.regions for rack in region]
    first_rack = [sum(len(r) for r in tree.regions[:i]) for i in range(len(tree.regions))]
    widest = max(map(len, racks))
    names = F.array(*[F.lit(s) for rack in racks for s in [*[s for s, _ in rack], *[-1] * (widest - len(rack))]])
    region_w = [[sum(w for rack in region for _, w in rack) for region in tree.regions]]
    rack_w = [[sum(w for _, w in rack) for rack in region] for region in tree.regions]
    shard_w = [[w for _, w in rack] for rack in racks]
    df = df.withColumn("_region", _descend("region", F.lit(0), region_w, keys))
    df = df.withColumn("_rack", _descend("rack", F.col("_region"), rack_w, keys) + F.element_at(F.array(*map(F.lit, first_rack)), F.col("_region") + 1))
    child = _descend("shard", F.col("_rack"), shard_w, keys)
    return df.withColumn(out, F.element_at(names, F.col("_rack") * widest + child + 1)).drop("_region", "_rack")


def shard(df: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)``; slots count from 0 without gaps in a shard.

    The text is read once and never shuffled; slots are a two-level count over hash ranges of a
    shard, so that a shard of any size is numbered by many tasks.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    slim = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = place(slim, tree, ["doc_id"], "shard")
    slim = place(slim, grow(tree), ["doc_id"], "grown_shard")
    slim = keep(slim.withColumn("_h", F.xxhash64("doc_id", "text_crc32", "size")), "shard")
    bits = hash_bits(slim.count() // len(tree.shards))
    placed = running_offset(slim, ["shard"], "_h", ["doc_id", "text_crc32", "size"], F.lit(1), "slot", bits)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
