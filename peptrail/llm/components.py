"""Connected components by alternating large-star and small-star steps.

Edges only are moved. A round counts every node's smaller and larger neighbours once, and writes these counts
down by node, so that edges meet them where they are; what they add up to (whether links are stars, and whether a node has very many
edges) is observed on the way and costs no look of its own. A node of at most `bound` smaller neighbours
has them put together in one row. Edges of a node of more of them on a side would land in one task; such nodes, of
which there are at most the edges over the bound, meet their edges by a broadcast instead. The number of
rounds grows with the logarithm of the longest path, not with its length.

Defined results: edges of a node with itself and repeated edges change nothing; edges with a null end are
ignored; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, cut_as_is, free

#: A node of more edges to larger or to smaller nodes than this, and than a share of all edges, is met by a broadcast of at most MOST_HOT rows.
HOT_EDGES, MOST_HOT = 1000, 100_000


def small_stars(lists: DataFrame) -> DataFrame:
    """Of rows (a, smaller: some nodes below a): edges (a, b) of these nodes, and of a, to the least of them."""
    ends = lists.select(F.array_min("smaller").alias("b"), F.explode(F.concat("smaller", F.array("a"))).alias("a"))
    return ends.select("a", "b").where("a != b")


def _neighbours(links: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """For every node u: m (the least of its neighbours and itself), down and up (numbers of smaller and larger neighbours); and facts of all nodes."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    ends = links.select(ends.alias("e")).select("e.u", "e.v")
    near = ends.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up"))
    near = near.select("u", F.least("u", "m").alias("m"), "down", "up")
    seen = Observation()
    # Links are stars if each node has one link, to a node without one; another step would then change nothing.
    odd = (F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)
    near = cut_as_is(near.observe(seen, F.sum("down").alias("edges"), F.max("down").alias("down"), F.max("up").alias("up"), F.count_if(odd).alias("odd")))
    return near, {k: v or 0 for k, v in seen.get.items()}


def _large_star(links: DataFrame, near: DataFrame, facts: dict[str, int], bound: int) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours and itself."""
    rows = links.select(F.col("b").alias("u"), "a")
    if facts["up"] <= bound:
        met = rows.join(near.select("u", "m"), "u")
    else:
        hot = F.broadcast(near.where(F.col("up") > bound).select("u", "m"))
        met = rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(near.where(F.col("up") <= bound).select("u", "m"), "u"))
    return met.select("a", F.col("m").alias("b")).where("a != b")


def _small_star(links: DataFrame, near: DataFrame, facts: dict[str, int], bound: int) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the least of them. Links may be repeated, and have no more smaller neighbours than `near` counts."""
    if facts["down"] <= bound:
        return small_stars(links.groupBy("a").agg(F.collect_set("b").alias("smaller")))
    links = cut(links.distinct())
    hot = F.broadcast(near.where(F.col("down") > bound).select(F.col("u").alias("a")))
    out = small_stars(links.join(hot, "a", "left_anti").groupBy("a").agg(F.collect_set("b").alias("smaller")))
    many = links.join(hot, "a", "left_semi")
    least = many.groupBy("a").agg(F.min("b").alias("m"))  # as many rows as there are hot nodes at most
    met = many.join(F.broadcast(least), "a")
    return out.union(met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b"))


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of bigint nodes: node, root (the least node of its component), for every node that is not its own root."""
    links = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    near, facts = _neighbours(links)
    while facts["odd"]:
        bound = max(HOT_EDGES, facts["edges"] // MOST_HOT)
        links = cut(_small_star(_large_star(links, near, facts, bound), near, facts, bound).distinct())
        near, facts = _neighbours(links)
        free(links.sparkSession)  # the step's shuffles, and the edges before it
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
