"""Connected components of members and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.work import cut, drop_cut


def components(memberships: DataFrame, label: str) -> DataFrame:
    """(p, c): for each member the smallest member of its component, from memberships (p, g) in groups."""
    return linked(stars(memberships), label)


def stars(memberships: DataFrame) -> DataFrame:
    """(p, q): each member with the smallest member of each of its groups."""
    return memberships.join(memberships.groupBy("g").agg(F.min("p").alias("q")), "g").select("p", "q")


def linked(pairs: DataFrame, label: str) -> DataFrame:
    """(p, c): for each node of the pairs (p, q), q <= p, the smallest node of its component; a node without row is its own.

    Most components are stars around their smallest node, which one aggregate shows. Only what is left,
    the smallest nodes of members that have several and of members that others point to, is contracted
    round by round: each node gives way to the first of its neighbours, in the order of their numbers and
    later of a hash of the round, so chains shrink by a constant factor whatever their order. Rows are
    written to the shared folder in between, and all steps are aggregates with partial results and joins.
    """
    first = cut(pairs.groupBy("p").agg(F.min("q").alias("m"), F.max("q").alias("t")), label)
    several = pairs.join(first.where("m < t").select("p", "m"), "p").where("q != m").select(F.col("q").alias("a"), F.col("m").alias("b"))
    chained = first.where("m < p").select("p", "m").join(pairs.where("q < p").select(F.col("q").alias("p")), "p", "left_semi")
    edges = cut(several.unionByName(chained.select(F.col("p").alias("a"), F.col("m").alias("b"))).distinct(), label)
    if edges.isEmpty():
        return first.select("p", F.col("m").alias("c"))
    core = _contracted(edges, label)
    apart = first.join(core.select(F.col("p").alias("m"), "c"), "m", "left").select("p", F.coalesce("c", "m").alias("c"))
    return apart.unionByName(core.join(first, "p", "left_anti"))


def _contracted(edges: DataFrame, label: str) -> DataFrame:
    """(p, c): the smallest node of each node's component, from edges (a, b) between different nodes."""
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, k=len(maps): F.struct((F.xxhash64(c, F.lit(k)) if k else F.lit(0).cast("long")).alias("r"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("o")))
        step = both.groupBy("v").agg(F.min(rank("o")).alias("o"))
        step = cut(step.select("v", F.least(F.col("o"), rank("v")).getField("v").alias("f")), label)
        ends = edges.join(step.select(F.col("v").alias("a"), F.col("f").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("f").alias("y")), "b")
        new = cut(ends.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), label)
        drop_cut(edges)
        edges = new
        maps.append(step)
    whole = maps.pop()
    while maps:
        whole = maps.pop().join(whole.select(F.col("v").alias("f"), F.col("f").alias("to")), "f", "left").select("v", F.coalesce("to", "f").alias("f"))
    whole = cut(whole, label)
    return cut(whole.join(whole.groupBy("f").agg(F.min("v").alias("c")), "f").select(F.col("v").alias("p"), "c"), label)
