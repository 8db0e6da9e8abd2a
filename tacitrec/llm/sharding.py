"""Shards from a hierarchical weighted hash tree: region, then rack, then shard.

At every level the children of the node reached so far draw a number each, hashed from the
row's key, the place in the tree and the child, and scaled by the child's weight: the smallest
of -ln(u) / weight wins, so a child is taken with probability weight / sum of weights. A change
of one child's weight moves rows only to or from that child; draws elsewhere stay the same. A
shard that comes as a region of its own (`with_one_more`) therefore takes rows only into itself.

Assigning a shard is an expression over the key: no shuffle. Null keys count as the empty
string and share a shard. Equal keys share a shard, equal texts need not: the key decides. A
table without rows gives none. Columns named `shard` or `slot` in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacitrec.llm.common import numbered, replaced, uniform

Tree = tuple[tuple[tuple[float, ...], ...], ...]  # weights of shards by region and rack


def balanced_tree(regions: int, racks: int, shards: int) -> Tree:
    """Equal weights; shards are numbered in order of region, rack and place."""
    return tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions))


def with_one_more(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own; it gets the next number."""
    return (*tree, ((weight,),))


def _array(values: Sequence) -> Column:
    return F.array(*[_array(v) if isinstance(v, (list, tuple)) else F.lit(v) for v in values])


def _winner(weights: Column, *path: Column) -> Column:
    """Index of the child with the smallest draw; on a tie the smaller index."""
    draws = F.transform(
        weights, lambda w, i: F.struct((-F.log(uniform(*path, i)) / w).alias("draw"), i.cast("int").alias("child"))
    )
    return F.array_min(draws)["child"]


def _at(nested: Column, index: Column) -> Column:
    return F.get(nested, index)


def assign(df: DataFrame, key: str, tree: Tree, shard: str = "shard") -> DataFrame:
    """Add the column `shard` to every row."""
    sums = [[sum(rack) for rack in region] for region in tree]
    first, firsts = 0, []
    for region in tree:
        firsts.append([])
        for rack in region:
            firsts[-1].append(first)
            first += len(rack)
    id_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    region, rack = F.col("`__region`"), F.col("`__rack`")
    steps = df.withColumn("__region", _winner(_array([sum(s) for s in sums]), id_text, F.lit("region")))
    steps = steps.withColumn("__rack", _winner(_at(_array(sums), region), id_text, F.lit("rack"), region))
    place = _winner(_at(_at(_array(tree), region), rack), id_text, F.lit("shard"), region, rack)
    number = (_at(_at(_array(firsts), region), rack) + place).cast("int")
    return replaced(steps, **{shard: number}).drop("__region", "__rack")


def slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps, by `order`; equal rows in some order."""
    return numbered(df.drop(slot), shard, order, slot, "shard-slots")
