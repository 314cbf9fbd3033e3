"""A manifest of a dataset as hash trees: one tree a source, and one over the sources' roots; proofs for every row.

Leaves are hashes of rows. Nodes of a tree are numbered in order; every FAN consecutive ones become the node
above them, until one is left. The build goes bottom-up in steps of LEVELS levels, each step a written table
whose rows hold up to FAN ** LEVELS consecutive nodes, the levels between, and the node that they become.
Proofs go top-down: the rows of a step join the nodes of the step above (their parents), inherit the suffix of
the proof from there, and each child prepends its own siblings to it. Only hashes and ids are ever shuffled.

Defined results: each field of a leaf is `-` where it is null, else its count of bytes, a colon and its text.
A null source is a source of its own, before all others; null ids come first in their source; rows of one id
are ordered by their leaves, so equal rows, which have equal leaves, keep a row and a proof each. Other columns
are ignored. A source of one row has that row's leaf as its root, a table of one source has its root as the
whole root, and the proof of both is empty. An empty table has no rows and no root. Texts of any length are
hashed whole, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Nodes that become one, levels that a written step covers, and the nodes that a row of a step holds at most.
FAN, LEVELS = 3, 4
SPAN = FAN**LEVELS

#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """The hash of a document's fields, each with its length before it; a field may be given another value."""
    values = [(fields or {}).get(name, F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, place, digest, carried) with i, from 0 in the order of place in their tree, and total, the tree's nodes.

    Ranges of (tree, place) are sorted where they lie; a tree that many ranges share gets its numbers from
    counts of ranges, so that no tree is ranked by one task."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartitionByRange(parts, "tree", "place", "digest").sortWithinPartitions("tree", "place", "digest")
    # The number of a row's range is in its upper bits, and numbers of a range are without gaps.
    rows = cut(ordered.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    ranges = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return rows.join(ranges, ["tree", "part"]).select("tree", "digest", "carried", (F.col("row") + F.col("shift")).alias("i"), "total")


def _above(level: Column) -> Column:
    """The level above a run of nodes."""
    return F.transform(F.sequence(F.lit(0), F.size(level) - 1, F.lit(FAN)), lambda k: F.sha2(F.array_join(F.slice(level, k + 1, F.lit(FAN)), ""), 256))


def _step(nodes: DataFrame) -> DataFrame:
    """Rows of up to SPAN consecutive nodes: tree, total, g (the row's number), members, the levels l0, l1, .. over them, and the node that they become.

    A level is there only while its tree has several nodes; a whole tree in one row ends below LEVELS."""
    member = F.struct("i", "digest", "carried")
    rows = nodes.groupBy("tree", "total", F.expr(f"i div {SPAN}").alias("g")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("l0", F.transform("members", lambda m: m["digest"]))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"l{k}", F.when(F.col("total") > FAN ** (k - 1), _above(F.col(f"l{k - 1}"))))
    node = F.coalesce(*(F.get(F.col(f"l{k}"), F.lit(0)) for k in range(LEVELS, -1, -1)))
    return rows.withColumn("node", node).drop(f"l{LEVELS}")


def build(nodes: DataFrame, path: str) -> int:
    """Write the steps over nodes (tree, place, digest, carried) below a path, lowest first; how many there are."""
    spark = nodes.sparkSession
    level = cut(numbered(nodes))
    most, steps = level.agg(F.max("total")).first()[0] or 0, 0
    while True:
        _step(level).write.parquet(f"{path}/step{steps}")
        steps += 1
        if most <= SPAN:
            return steps
        most = -(-most // SPAN)
        here = spark.read.parquet(f"{path}/step{steps - 1}").where(F.col("total") > SPAN)
        level = here.select("tree", F.col("node").alias("digest"), F.lit(None).cast("int").alias("carried"), F.col("g").alias("i"), F.expr(f"(total + {SPAN - 1}) div {SPAN}").alias("total"))


def _roots(spark: SparkSession, path: str, steps: int) -> DataFrame:
    """tree, node of every whole tree; a tree ends in the step where one row holds it."""
    each = [spark.read.parquet(f"{path}/step{k}").where(F.col("total") <= SPAN).select("tree", "node") for k in range(steps)]
    return reduce(DataFrame.unionByName, each)


def _own(q: Column, level: Column) -> Column:
    """The siblings of the q-th node of a level: what stands left and right of it in its run."""
    within = q % FAN
    text = lambda start, length: F.array_join(F.slice(level, start, length), "")
    return F.struct(text(q - within + 1, within).alias("left"), text(q + 2, F.lit(FAN - 1) - within).alias("right"))


def _children(rows: DataFrame) -> DataFrame:
    """Members of a step's rows, each with its proof: its own siblings up to its row's node, then what the row has inherited."""
    each = rows.select("*", F.posexplode("members").alias("q", "member"))
    own = [F.when(F.col("total") > FAN**k, _own(F.expr(f"q div {FAN**k}"), F.col(f"l{k}"))) for k in range(LEVELS)]
    proof = F.concat(F.filter(F.array(*own), lambda s: s.isNotNull()), F.col("suffix"))
    return each.select("tree", "member.*", proof.alias("proof"), "subroot", "root")


def push(spark: SparkSession, path: str, steps: int, tops: DataFrame | None = None) -> DataFrame:
    """tree, i, digest, carried, proof, subroot, root of every lowest node.

    Whole trees inherit from tops (tree, suffix, root); without tops, the tree's own root is the root of all."""
    down = None
    for k in reversed(range(steps)):
        step = spark.read.parquet(f"{path}/step{k}")
        whole = step.where(F.col("total") <= SPAN).withColumn("subroot", F.col("node"))
        if tops is None:
            empty = F.array().cast("array<struct<left:string,right:string>>")
            rows = whole.withColumn("suffix", empty).withColumn("root", F.col("node"))
        else:
            rows = whole.join(tops, "tree")
        if down is not None:
            parents = down.select("tree", F.col("i").alias("g"), F.col("proof").alias("suffix"), "subroot", "root")
            rows = rows.unionByName(step.where(F.col("total") > SPAN).join(parents, ["tree", "g"]))
        down = _children(rows)
    return down


def write(docs: DataFrame, path: str, also: dict[str, Column] | None = None) -> tuple[int, int]:
    """Write the manifest of documents below a path; the numbers of steps of the sources' trees and of the tree over them.

    also: columns that travel with a leaf into the manifest, beside the id."""
    spark = docs.sparkSession
    prepare(spark)
    # Nulls first, then by bytes: "-" is below "=".
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    carried = F.struct("doc_id", *(c.alias(name) for name, c in (also or {}).items()))
    leaves = cut(docs.select(tree.alias("tree"), F.col("doc_id").alias("place"), leaf().alias("digest"), carried.alias("carried")))
    low = build(leaves, f"{path}/sources")
    subroots = _roots(spark, f"{path}/sources", low)
    high = build(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("place"), F.col("node").alias("digest"), F.col("tree").alias("carried")), f"{path}/top")
    return low, high


def proofs(spark: SparkSession, path: str, steps: tuple[int, int]) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (left and right siblings by level) of every row of a manifest, and the columns that travelled with it."""
    tops = push(spark, f"{path}/top", steps[1]).select(F.col("carried").alias("tree"), F.col("proof").alias("suffix"), "root")
    rows = push(spark, f"{path}/sources", steps[0], tops)
    return rows.select("carried.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All hashes of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
