"""Readers, writers, embedding, models, streaming."""

from peptrail.plans import embed, models
from peptrail.sources import readers, sinks
from peptrail.streaming import arrivals


def test_assay_round_trip(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("序列,类别,作用位点,MIC\nLRLR,fungus,Lipid Bilayer,2.5\nAAAA,fungus,,\n", encoding="utf-8")
    found = readers.assay(spark, str(path)).orderBy("src_ord").collect()
    assert [(r.seq, r.target_site, r.mic) for r in found] == [("LRLR", "Lipid Bilayer", 2.5), ("AAAA", None, None)]


def test_lines_csv_json(spark, tmp_path):
    df = spark.createDataFrame([(0, "AAAA", 3), (1, "CCCC", 2)], "i long, seq string, score long")
    sinks.write_lines(df, "seq", f"{tmp_path}/lines")
    assert sorted(r.seq for r in readers.sequences(spark, f"{tmp_path}/lines").collect()) == ["AAAA", "CCCC"]
    sinks.ranked_csv(df, f"{tmp_path}/csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()] == [("AAAA", "3"), ("CCCC", "2")]
    sinks.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert sinks.parameters({"b": 1, "a": 2}, spark).first()["param"] == "a"
    assert readers.literal_rows(spark).count() == 35


def test_embedding_cache(spark, tmp_path):
    path = f"{tmp_path}/cache"
    df = spark.createDataFrame([("AA",), ("CC",), ("AA",)], "seq string")
    assert readers.embedding_cache(spark, path).count() == 0

    def load(_):
        return lambda batch: [[float(len(s)), 1.0] for s in batch]

    _, new = embed.embed(df, readers.embedding_cache(spark, path), load)
    sinks.append_cache(path, new)
    both, new = embed.embed(df.union(spark.createDataFrame([("DDD",)], "seq string")), readers.embedding_cache(spark, path), load)
    assert [r.seq for r in new.collect()] == ["DDD"] and both.count() == 3


def test_models_save_and_select(spark, tmp_path):
    df = spark.createDataFrame([([float(i % 7), float(i % 3)], float(i % 3 == 1)) for i in range(120)], "features array<double>, label double")
    small = models.Settings(rounds=2, depth=2, least_rows=1, folds=2, grid={"maxDepth": [1, 2]})
    assert small.candidates() == 2
    model = models.fit_classifier(df, small)
    models.save(model, f"{tmp_path}/m")
    first, again = models.predict(model, df), models.predict(models.load(f"{tmp_path}/m"), df)
    assert first.columns == ["features", "label", "prediction"] and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert models.importances(model, spark).count() >= 1 and models.selected(model, 2)


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([("LRLLRLRLRLLRLR",), ("GGGG",)], "value string").write.text(f"{tmp_path}/in")
    q = arrivals.store(arrivals.described(arrivals.arriving(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r.seq for r in found] == ["LRLLRLRLRLLRLR"] and round(found[0].charge, 5) == 5.99009


def test_stamped_reports_and_snapshots(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 1, 31, 23, 59, 58)
    df = spark.createDataFrame([(1, 0.5), (0, 0.25)], "label int, f1 double")
    path = sinks.report({"classes": df, "again": df}, str(tmp_path), "metrics", at)
    assert path.endswith("/metrics_20240131_235958")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["# classes", "label\tf1", "0\t0.2500", "1\t0.5000", "# again", "label\tf1", "0\t0.2500", "1\t0.5000"]
    assert spark.read.option("header", True).csv(sinks.snapshot(df, str(tmp_path), "curated", at)).count() == 2


def test_sequence_functions_in_sql(spark):
    from pyspark.sql import functions as F

    from peptrail.functions import sequence

    sequence.register(spark)
    rows = spark.createDataFrame([("G",), ("K",), ("DDDD",), ("LRLLRLRLRLLRLR",), ("KKKKKKKKKKKKKK",)], "seq string")
    found = rows.select("seq", F.expr("isoelectric_point(seq)").alias("x"), sequence.isoelectric_point(F.col("seq")).alias("y"), F.expr("net_charge(seq)").alias("c"), sequence.charge(F.col("seq")).alias("d")).collect()
    assert all(r.x == r.y and abs(r.c - r.d) < 1e-9 for r in found) and found[0].x == 4.0 and found[-1].x is None


def test_rows_are_in_the_order_of_files(spark, tmp_path):
    """Files of unequal size, read in several blocks, by names and not by size."""
    lines, sizes = [], {"a": 3, "b": 4000, "c": 0, "d": 1500, "e": 1}
    for name, n in sizes.items():
        own = [f"{name}{k} " + "x" * (k % 50) + "  " for k in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in own))
        lines += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = readers.sequences(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.seq for r in sorted(found)] == lines and sorted(r.seq_id for r in found) == list(range(len(lines)))


def test_a_worker_loads_its_model_once(spark, tmp_path):
    (tmp_path / "artefacts").mkdir()
    (tmp_path / "artefacts" / "offset").write_text("100")
    log = tmp_path / "log"
    log.mkdir()
    place = str(log)

    def load(folder):
        import os
        import uuid

        with open(f"{place}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        with open(f"{folder}/offset") as f:
            offset = float(f.read())
        return lambda seqs: [[offset + len(s), float(len(seqs))] for s in seqs]

    df = spark.createDataFrame([("A" * (1 + k % 90) + "C" * (k // 90),) for k in range(900)], "seq string").repartition(12)
    _, new = embed.embed(df, readers.embedding_cache(spark, f"{tmp_path}/none"), load, name=place, artefacts=str(tmp_path / "artefacts"))
    for _ in range(2):
        found = {r.seq: r.embedding[0] for r in new.collect()}
        assert found == {r.seq: 100.0 + len(r.seq) for r in df.collect()}
    pids = [p.name.split("-")[0] for p in log.iterdir()]
    assert 1 <= len(set(pids)) == len(pids)


def test_batches_of_like_length():
    seen = []

    def model(seqs):
        seen.append(seqs)
        return [[float(len(s))] for s in seqs]

    seqs = ["A" * n for n in (5, 1, 9, 2, 100, 3, 9)]
    assert embed.in_batches(model, seqs, 20) == [[float(len(s))] for s in seqs]
    assert [len(s[-1]) * len(s) <= 20 or len(s) == 1 for s in seen] == [True] * len(seen) and [len(x) for s in seen for x in s] == sorted(map(len, seqs))
    assert embed.in_batches(model, []) == []


def test_counters_of_a_screen(spark):
    """Stages of a screen are counted while it runs."""
    from pyspark.sql import functions as F

    from peptrail.operators.statistics import Counters
    from peptrail.plans import screen
    from peptrail.plans.models import Settings

    rows = spark.createDataFrame([(k, f"S{k}", [float(k % 7), float(k)], float(k % 7 > 2), float(k % 3)) for k in range(60)], "seq_id long, seq string, features array<double>, label double, third double")
    small = Settings(rounds=2, depth=2, least_rows=1, subsample=1.0, scaler="standard")
    classifier = models.fit_classifier(rows, small, key="seq_id")
    regressor = models.fit_regressor(rows.withColumn("label", F.col("seq_id") / 10.0), small, key="seq_id")
    pairs_of = rows.select((F.concat("features", "features", "features", "features")).alias("features"), F.col("third").alias("label"), "seq_id")
    comparator = models.fit_comparator(pairs_of, small, key="seq_id")
    watch = Counters()
    found = screen.screen(rows.select("seq_id", "seq", "features"), classifier, comparator, regressor, best=5, watch=watch).collect()
    counts = watch.counts()
    positives = sum(1 for r in models.predict(classifier, rows).collect() if r.prediction == 1)
    assert counts == {"rows": 60, "positives": positives, "pairs": positives * (positives - 1) // 2, "ranked": 5} and len(found) == 5


def test_structure_block(spark):
    from pyspark.sql import functions as F

    from peptrail.functions.sequence import REGISTRY
    from peptrail.plans import train

    rows = spark.createDataFrame([(0, "LRLR", 1.0), (1, "KKKK", 2.0), (2, "LRLR", 3.0), (3, "GGGG", 4.0)], "row_id long, seq string, mic double")
    vectors = rows.select("row_id", F.array(F.col("row_id").cast("float")).alias("embedding"))
    structure = spark.createDataFrame([("LRLR", 7.0, 8.0), ("GGGG", None, 9.0)], "seq string, helix double, sheet double")
    n = len(REGISTRY)
    block = lambda **more: {r.row_id: r.features[n : n + 2] for r in train.feature_rows(rows, vectors, structure=structure, columns=("helix", "sheet"), **more).collect()}
    assert block() == {0: [0.0, 0.0], 1: [0.0, 0.0], 2: [7.0, 8.0], 3: [0.0, 9.0]}
    assert block(all_duplicates=True)[0] == [7.0, 8.0]
    assert {len(r.features) for r in train.feature_rows(rows, vectors).collect()} == {n + 1}
