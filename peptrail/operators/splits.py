"""Deterministic samples, splits and folds by a hash of the row's key; no result depends on partitioning.

The hash is plain arithmetic on whole numbers, so any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A prime modulus; products with keys below 2 ** 31 stay within 63 bits.
MODULUS = 2_147_483_647
SLICE_ROWS = 200_000
#: Samples up to so many rows are merged by one task.
MERGED = 10_000


def chance(key: Column, seed: int | Column) -> Column:
    """A whole number below MODULUS for a key."""
    k = F.pmod(key.cast("bigint"), F.lit(MODULUS))
    once = F.pmod(k * 48_271 + seed, F.lit(MODULUS))
    return F.pmod(once * 16_807 + 7 * seed + 1, F.lit(MODULUS))


def random_split(df: DataFrame, test: float = 0.2, seed: int = 6, key: str = "row_id") -> DataFrame:
    """Add part: test for about the share asked for, else train."""
    return df.withColumn("part", F.when(chance(F.col(key), seed) < int(test * MODULUS), "test").otherwise("train"))


def stratified_split(df: DataFrame, stratum: str, test: float = 0.2, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Add part: of each stratum, the rounded share asked for goes to test, those of the lowest hash.

    Rows are ranked in slices of the hash's range, with the slices' counts before them, so that a stratum is
    never ranked by one task."""
    slices = max(1, min(1 << 16, df.count() // SLICE_ROWS))
    hashed = df.withColumn("_h", chance(F.col(key), seed)).withColumn("_slice", F.floor(F.col("_h") * slices / F.lit(MODULUS)).cast("int"))
    counts = hashed.groupBy(stratum, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(stratum)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(stratum).alias("_stratum"), "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_all"))
    place = F.row_number().over(Window.partitionBy(stratum, "_slice").orderBy("_h", key))
    ranked = hashed.withColumn("_place", place).join(counts, F.col(stratum).eqNullSafe(F.col("_stratum")) & (hashed["_slice"] == counts["_slice"]))
    test_row = F.col("_base") + F.col("_place") <= F.floor(F.col("_all") * test + 0.5)
    return ranked.select(*df.columns, F.when(test_row, "test").otherwise("train").alias("part"))


def quantile_split(df: DataFrame, column: str, test: float = 0.1, q: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Add bin (of quantiles of a numeric column) and part, of which each bin gives its share; rows without a value are left out."""
    from .statistics import quantile_bins

    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return stratified_split(quantile_bins(known, column, q), "bin", test, seed, key)


def kfold(df: DataFrame, folds: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Add fold, from 0."""
    return df.withColumn("fold", F.pmod(chance(F.col(key), seed), F.lit(folds)).cast("int"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """n rows without replacement, those of the lowest hash, all when there are fewer; equal hashes are taken in the order of their keys.

    Up to MERGED rows each task keeps n and one merges them. Beyond, the n-th lowest hash is found by counts of
    ranges, and rows are compared with it: nothing is sorted or merged. Both give the same rows."""
    from .quantiles import values_at

    if n <= MERGED:
        return df.orderBy(chance(F.col(key), seed), key).limit(n)
    hashed = df.withColumn("_h", chance(F.col(key), seed))
    total = df.count()
    if total <= n:
        return df
    at = hashed.sparkSession.createDataFrame([(0, n - 1)], "place int, rank bigint")
    last = values_at(hashed.select(F.lit(0).alias("place"), F.col("_h").alias("x")), at).first()["value"]
    below = hashed.where(F.col("_h") < last)
    # Keys that share the last hash differ by multiples of the modulus, or are equal.
    level = hashed.where(F.col("_h") == last).orderBy(key).limit(n - below.count())
    return below.unionByName(level).drop("_h")


#: Rounds of the permutation, an even number; each adds a mix of one half of a number to the other half.
ROUNDS = 6


def permuted(number: Column, high: int, low: int, seed: int) -> Column:
    """Whole numbers below high * low moved by a permutation of them, for factors up to MODULUS.

    The halves, number div low and number mod low, are moved by turns: each round adds a mix of one half to the
    other. As a round is undone by taking away what it added, no two numbers meet; the factors fill the range
    exactly, so no number has to walk back into it."""

    def mix(x: Column, s: Column) -> Column:
        # The square keeps rounds from being one affine map.
        once = chance(x, s)
        return chance(F.pmod(once * once, F.lit(MODULUS)) + x, s + 1)

    def two_rounds(state: Column, s: Column) -> Column:
        a = F.pmod(state["a"] + mix(state["b"], s), F.lit(high))
        return F.struct(a.alias("a"), F.pmod(state["b"] + mix(a, s + 2), F.lit(low)).alias("b"))

    start = F.struct(F.call_function("div", number, F.lit(low)).alias("a"), (number % F.lit(low)).cast("bigint").alias("b"))
    seeds = F.array(*(F.lit(seed + 2 * k).cast("bigint") for k in range(0, ROUNDS, 2)))
    return F.aggregate(seeds, start, two_rounds, lambda state: state["a"] * F.lit(low) + state["b"])
