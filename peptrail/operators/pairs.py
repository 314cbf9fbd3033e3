"""All pairs i < j of numbered items, in order, up to a cap, and tournament scores over them.

Pairs are numbered in closed form. All pairs up to a cap are made by meetings of blocks of items; sampled numbers
are decoded to (i, j) and the items fetched by two equality joins. Nothing is sorted, and blocks beyond the cap
never meet.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import permuted

CAP, BATCH = 10_000_000, 10_000


def pair_count(items: int) -> int:
    return items * (items - 1) // 2


def ordinal(i: Column, j: Column, items: int) -> Column:
    """Number, from 0, of the pair in lexicographic order."""
    return (i * (2 * items - i - 1) / 2).cast("bigint") + (j - i - 1)


def pair_of(number: int, items: int) -> tuple[int, int]:
    """(i, j) of a pair's number."""
    b = 2 * items - 1
    i = (b - isqrt(b * b - 8 * number)) // 2
    # The root is rounded down, so i may be one too high.
    i -= i * (b - i) // 2 > number
    return i, number - i * (b - i) // 2 + i + 1


def decoded(rows: DataFrame, items: int) -> DataFrame:
    """ordinal, i, j of rows with an ordinal."""
    o, b = F.col("ordinal"), float(2 * items - 1)
    guess = F.floor((F.lit(b) - F.sqrt(F.lit(b * b) - 8.0 * o)) / 2).cast("bigint")
    first = lambda i: F.floor(i * (F.lit(2 * items - 1) - i) / 2).cast("bigint")
    rows = rows.withColumn("g", F.greatest(guess, F.lit(0)))
    # The square root may be off by one either way.
    i = F.when(first(F.col("g")) > o, F.col("g") - 1).when(first(F.col("g") + 1) <= o, F.col("g") + 1).otherwise(F.col("g"))
    rows = rows.select("ordinal", F.coalesce(i, F.lit(-1)).alias("i"))
    # Never null, as Spark then knows: else it would test i and j for null below, by all that they are made of.
    return rows.select("ordinal", "i", F.coalesce(F.col("i") + 1 + o - first(F.col("i")), F.lit(-1)).alias("j"))


def pair_index(spark: SparkSession, items: int, cap: int | None = CAP) -> DataFrame:
    """ordinal, i, j of the first pairs, up to the cap."""
    total = pair_count(items) if cap is None else min(pair_count(items), cap)
    return decoded(spark.range(total).withColumnRenamed("id", "ordinal"), items)


def sampled_index(spark: SparkSession, items: int, n: int, seed: int = 42) -> DataFrame:
    """ordinal, i, j of as many pairs as asked for, all when there are fewer: the first n of a seeded permutation of all numbers.

    Only n numbers are made, however many pairs there are."""
    if n >= pair_count(items):
        return pair_index(spark, items, None)
    # Of items and items - 1 one is even, so the count of pairs has two factors of about the same size.
    high, low = (items // 2, items - 1) if items % 2 == 0 else (items, (items - 1) // 2)
    return decoded(spark.range(n).select(permuted(F.col("id"), high, low, seed).alias("ordinal")), items)


def _fetched(index: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    left = items.select("i", *(F.col(c).alias(f"{c}_i") for c in columns))
    right = items.select(F.col("i").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    return index.join(left, "i").join(right, "j")


#: Items of a block; two blocks of vectors are one row while their pairs are made.
BLOCK = 64


def paired(items: DataFrame, columns: list[str], cap: int | None = CAP, n: int | None = None) -> DataFrame:
    """ordinal, i, j and each column of both sides (suffixes _i, _j) of items numbered i from 0.

    Items are packed by blocks of BLOCK numbers, and every two blocks with a pair below the cap meet once, so that
    an item is sent once for each block that it meets, not for each pair. A meeting's pairs are made where it lies."""
    spark = items.sparkSession
    n = items.count() if n is None else n
    total = pair_count(n) if cap is None else min(pair_count(n), cap)
    blocks = -(-n // BLOCK)
    # Pairs are ordered by i, so a cap ends the blocks of i; what is over in the last of them is filtered.
    last = pair_of(total - 1, n)[0] // BLOCK if total else -1
    member = F.struct("i", *columns)
    packed = items.groupBy(F.expr(f"i div {BLOCK}").alias("block")).agg(F.collect_list(member).alias("members"))
    meetings = spark.range((last + 1) * blocks).select(F.expr(f"id div {blocks}").alias("low"), (F.col("id") % blocks).alias("high")).where("low <= high")
    side = lambda name: packed.select(F.col("block").alias(name), F.col("members").alias(f"{name}_members"))
    met = meetings.join(side("low"), "low").join(side("high"), "high")
    left = met.select(F.explode("low_members").alias("x"), "high_members")
    both = left.select("x", F.explode("high_members").alias("y")).where("x.i < y.i")
    number = F.expr(f"x.i * ({2 * n - 1} - x.i) div 2 + y.i - x.i - 1").alias("ordinal")
    sides = [F.col(f"{of}.{c}").alias(f"{c}_{name}") for name, of in (("i", "x"), ("j", "y")) for c in columns]
    return both.select(number, F.col("x.i").alias("i"), F.col("y.i").alias("j"), *sides).where(F.col("ordinal") < total)


def sampled_pairs(items: DataFrame, columns: list[str], n: int, seed: int = 42) -> DataFrame:
    """As many pairs as asked for out of all, chosen by a seeded permutation of their numbers; all when there are fewer.

    Numbers are chosen first, and only theirs are decoded and fetched."""
    return _fetched(sampled_index(items.sparkSession, items.count(), n, seed), items, columns)


def tournament(pairs: DataFrame, prediction: str = "prediction", prefer: str = "faithful") -> DataFrame:
    """i, score over pairs (i, j, prediction of 0, 1 or 2): 1 takes a point from i and gives one to j, 2 the reverse.

    Both sides of a pair come from one scan; sums are combined before the shuffle. prefer="low" turns the sign."""
    if prefer not in ("faithful", "low"):
        raise ValueError("prefer must be faithful or low")
    gain = F.when(F.col(prediction) == 1, -1).when(F.col(prediction) == 2, 1).otherwise(0) * (1 if prefer == "faithful" else -1)
    sides = F.array(F.struct(F.col("i").alias("i"), gain.alias("d")), F.struct(F.col("j").alias("i"), (-gain).alias("d")))
    return pairs.select(F.explode(sides).alias("s")).groupBy(F.col("s.i").alias("i")).agg(F.sum("s.d").cast("bigint").alias("score"))


def scored(items: DataFrame, pairs: DataFrame, prediction: str = "prediction", prefer: str = "faithful") -> DataFrame:
    """Items with their score; those in no pair have 0."""
    return items.join(tournament(pairs, prediction, prefer), "i", "left").withColumn("score", F.coalesce("score", F.lit(0)))


def batch_ties(pairs: DataFrame, prediction: str = "prediction", batch: int = BATCH) -> DataFrame:
    """batch (from 1), pairs, ties, percent of ties."""
    number = F.floor(F.col("ordinal") / batch).cast("bigint") + 1
    out = pairs.groupBy(number.alias("batch")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col(prediction) == 0).alias("ties"))
    return out.withColumn("tie_percent", F.col("ties") * 100.0 / F.col("pairs"))
