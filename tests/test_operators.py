"""Operators on small frames: edge rows, order, ties, determinism."""

import math

import pytest
from pyspark.sql import functions as F

from peptrail.operators import curate, features, indexing, metrics, pairs, ranking, scaling, splits, statistics


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_curation_keeps_first_and_missing_sites(spark):
    df = spark.createDataFrame([(0, "AA", "en", None, 1.0), (1, "AA", "en", None, 2.0), (2, "AA", "en", "x src1", 3.0), (3, "BB", "en", "src2", 4.0), (4, "CC", "fr", None, 5.0)], "row_id long, seq string, category string, target_site string, mic double")
    assert [r[0] for r in rows(curate.curate(df, "en", "src1").select("row_id"))] == [0, 2]
    assert [tuple(r) for r in curate.stage_counts(df, "en", "src1").orderBy("stage").collect()] == [("0_all", 5), ("1_category", 4), ("2_distinct", 3), ("3_site", 2), ("4_at_most", 2), ("5_above", 2)]
    again = curate.reindexed(df.where("row_id > 1"))
    assert rows(again.select("row_id", "new_id")) == [(2, 0), (3, 1), (4, 2)]


def test_bounds(spark):
    df = spark.createDataFrame([(0.24,), (0.25,), (8.0,), (8.0001,), (None,), (math.nan,)], "mic double")
    assert rows(curate.regression_rows(df).select("mic")) == [(0.25,), (8.0,)]


def test_structure_goes_to_last_duplicate(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "row_id long, seq string")
    s = spark.createDataFrame([("A", 5.0), ("Z", 9.0)], "seq string, x double")
    assert rows(features.structure_lookup(df, s, ["x"]).select("row_id", "x")) == [(0, 0.0), (1, 5.0), (2, 0.0)]
    assert rows(features.structure_lookup(df, s, ["x"], all_duplicates=True).select("row_id", "x")) == [(0, 5.0), (1, 5.0), (2, 0.0)]


def test_unknown_feature_mode(spark):
    with pytest.raises(ValueError):
        features.descriptors(spark.createDataFrame([("A",)], "seq string"), "other")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50])
def test_pair_index_is_a_bijection(spark, n):
    found = [tuple(r) for r in pairs.pair_index(spark, n, None).orderBy("ordinal").collect()]
    assert [(i, j) for _, i, j in found] == [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert len(pairs.pair_index(spark, n, 5).collect()) == min(5, n * (n - 1) // 2)


def test_pair_ordinal(spark):
    df = pairs.pair_index(spark, 9, None)
    assert df.where(pairs.ordinal(F.col("i"), F.col("j"), 9) != F.col("ordinal")).count() == 0


def test_scores_sum_to_zero(spark):
    items = spark.createDataFrame([(i, (i * 7) % 5) for i in range(20)], "i long, v int")
    met = pairs.paired(items, ["v"], None).withColumn("prediction", F.when(F.col("v_i") == F.col("v_j"), 0).when(F.col("v_i") < F.col("v_j"), 1).otherwise(2))
    scores = {r.i: r.score for r in pairs.scored(items, met).collect()}
    low = {r.i: r.score for r in pairs.scored(items, met, prefer="low").collect()}
    assert sum(scores.values()) == 0 and max(map(abs, scores.values())) <= 19 and all(low[i] == -s for i, s in scores.items())
    assert len(scores) == 20 and pairs.batch_ties(met, batch=100).count() == 2


def test_ties_keep_order(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "i long, score int")
    assert [r.i for r in ranking.top(df, 6).orderBy("rank").collect()] == [1, 3, 5, 7, 9, 0]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert tuple(round(v, 6) for v in df.agg(*statistics.summary(df, "x")).first()) == (1.0, 10.0, 4.0, 2.5, 3.535534)
    wide = spark.createDataFrame([([1.0],), ([2.0],), ([3.0],), ([10.0],)], "features array<double>")
    assert tuple(scaling.robust_fit(wide).first()) == (0, 2.5, 3.0)
    assert round(scaling.standard_fit(wide).first()["scale"], 7) == 3.5355339
    assert [r.n for r in statistics.histogram(df, "x", 3).orderBy("bin").collect()] == [3, 0, 1]
    assert statistics.histogram(df.limit(0), "x").count() == 0
    assert tuple(statistics.length_stats(spark.createDataFrame([], "seq string")).first()) == (0.0, 0, 0)
    tied = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "x double")
    assert {r.bin for r in statistics.quantile_bins(tied, "x").where("x = 1").collect()} == {0}


def test_metrics_with_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    report = {r.label: r for r in metrics.class_report(df).collect()}
    assert report[1].precision == 0.0 and report[1].f1 == 0.0 and report[0].recall == 1.0
    w = metrics.weighted(df).first()
    assert abs(w.accuracy - 2 / 3) < 1e-12 and w.accuracy == w.recall


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_splits_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("s")).repartition(partitions)
    found = splits.stratified_split(df, "s")
    assert {r["s"]: r["n"] for r in found.where("part = 'test'").groupBy("s").agg(F.count("*").alias("n")).collect()} == {0: 67, 1: 67, 2: 67}
    assert found.where("part = 'test'").agg(F.sum("row_id")).first()[0] == splits.stratified_split(df.coalesce(1), "s").where("part = 'test'").agg(F.sum("row_id")).first()[0]
    assert 0.15 < splits.random_split(df).where("part = 'test'").count() / 1000 < 0.25
    assert len({r.fold for r in splits.kfold(df).collect()}) == 5


def test_dense_index_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(indexing, "RANGE_ROWS", 100)
    df = spark.range(0, 2000, 2).withColumnRenamed("id", "k").repartition(5)
    assert [r.n for r in indexing.dense_index(df, "k", "n").orderBy("k").collect()] == list(range(1000))


def test_mean_pooled_and_rows_of(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k int, embedding array<double>")
    assert rows(features.mean_pooled(df, "k")) == [(1, [2.0, 3.0]), (2, [5.0, 6.0])]
    wanted = spark.createDataFrame([(2,), (2,)], "row_id int")
    assert features.rows_of(df.withColumnRenamed("k", "row_id"), wanted).count() == 2


def test_literal_rows(spark):
    from peptrail.plans import train
    from peptrail.sources import readers

    rows = spark.createDataFrame([(k, float(k), [float(k)]) for k in range(40)], "row_id long, mic double, features array<double>")
    literals = readers.literal_rows(spark)
    both = train.with_literals(rows, literals, faithful_append=True)
    assert both.count() == 75 and sorted(r.features[0] for r in both.where("row_id is null").collect()) == [float(k) for k in range(35)]
    described = spark.createDataFrame([(s, [7.0]) for s in readers.LITERAL_ROWS], "seq string, features array<double>")
    assert train.with_literals(rows, literals, described).where("features[0] = 7 and mic = 0.01").count() == 35
    with pytest.raises(ValueError):
        train.with_literals(rows.limit(3), literals, faithful_append=True)


def test_first_rows_and_text(spark):
    from peptrail.functions import numeric

    df = spark.createDataFrame([(k,) for k in (5, 3, 1, 4)], "seq_id long")
    assert sorted(r.seq_id for r in ranking.first_rows(df, 2).collect()) == [1, 3] and ranking.first_rows(df, None).count() == 4
    assert tuple(spark.range(1).select(numeric.two_places(F.lit(2.345678)), numeric.thousands(F.lit(1234567))).first()) == ("2.35", "1,234,567")


@pytest.mark.parametrize("high, low", [(1, 1), (1, 7), (5, 9), (20, 39), (64, 64), (97, 3)])
def test_permutation_meets_every_number_once(spark, high, low):
    for seed in (1, 42):
        found = [r.p for r in spark.range(high * low).select(splits.permuted(F.col("id"), high, low, seed).alias("p")).collect()]
        assert sorted(found) == list(range(high * low)) and (high * low < 10 or found != sorted(found))


def test_sampled_pairs_are_spread_evenly(spark):
    """800,000 of 5 * 10 ** 11 pairs: distinct, in range, and even over i, j and both."""
    items, n = 1_000_000, 800_000
    found = pairs.sampled_index(spark, items, n).persist()
    assert found.distinct().count() == n and found.where(f"i < 0 or i >= j or j >= {items}").count() == 0
    # The chance of i below x of all is 1 - (1 - x) ** 2, that of j is x ** 2.
    parts = found.agg(*(F.avg((F.col(c) < x * items).cast("int")).alias(f"{c}{k}") for c in "ij" for k, x in enumerate((0.1, 0.5, 0.9)))).first()
    want = [1 - 0.9**2, 0.75, 0.99, 0.01, 0.25, 0.81]
    assert all(abs(a - b) < 5 * (b * (1 - b) / n) ** 0.5 for a, b in zip(parts, want, strict=True))
    both = found.groupBy((F.col("ordinal") % 97).alias("a"), (F.col("ordinal") % 89).alias("b")).count()
    chi = both.agg(F.sum((F.col("count") - n / 8633) ** 2 / (n / 8633))).first()[0]
    assert abs(chi - 8632) < 6 * (2 * 8632) ** 0.5
    gaps = found.agg(F.corr("i", "j"), F.avg((F.col("ordinal") % 2).cast("double"))).first()
    assert abs(gaps[0] - 0.5) < 0.01 and abs(gaps[1] - 0.5) < 0.003
    found.unpersist()


def test_sample_without_a_sort(spark, monkeypatch):
    from peptrail.operators import quantiles

    monkeypatch.setattr(quantiles, "SORTED", 20)
    # Keys that share hashes: equal, or apart by the modulus.
    keys = [*range(300), 5, 5, 5 + splits.MODULUS, 17 + splits.MODULUS]
    df = spark.createDataFrame([(k,) for k in keys], "row_id long").repartition(3)
    order = sorted(keys, key=lambda k: ((((k % splits.MODULUS * 48271 + 42) % splits.MODULUS) * 16807 + 295) % splits.MODULUS, k))
    for n, merged in ((0, 9), (2, 9), (60, 0), (303, 0), (500, 0)):
        monkeypatch.setattr(splits, "MERGED", merged)
        assert sorted(r.row_id for r in splits.sample_rows(df, n).collect()) == sorted(order[:n])


@pytest.mark.parametrize("n, cap, block", [(0, None, 4), (1, None, 4), (2, None, 4), (9, None, 4), (9, 20, 4), (33, 100, 4), (33, 1, 4), (40, None, 64), (33, 31, 5)])
def test_pairs_of_blocks(spark, monkeypatch, n, cap, block):
    from itertools import combinations

    monkeypatch.setattr(pairs, "BLOCK", block)
    items = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(n)], "i long, v array<double>")
    found = sorted((r.ordinal, r.i, r.j, r.v_i[0], r.v_j[0]) for r in pairs.paired(items, ["v"], cap).collect())
    assert found == [(k, i, j, float(i), float(j)) for k, (i, j) in enumerate(combinations(range(n), 2))][:cap]


def test_pair_of_a_number():
    for n in (2, 3, 50, 999_999, 3 * 10**9):
        total = pairs.pair_count(n)
        for number in {0, 1, n - 2, total // 3, total // 2, total - 1} & set(range(total) if n < 60 else [0, 1, n - 2, total // 3, total // 2, total - 1]):
            i, j = pairs.pair_of(number, n)
            assert 0 <= i < j < n and i * (2 * n - 1 - i) // 2 + j - i - 1 == number


def test_vectors_are_sent_by_blocks(spark):
    """Shuffled rows of the plan are blocks and meetings, as many as pairs of blocks, not of items."""
    items = spark.range(640).select(F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("v"))
    plan = pairs.paired(items, ["v"], None, 640)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.index("Generate explode(high_members") < plan.index("Join")
