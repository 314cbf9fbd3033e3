"""Quality rules: fixed counts, and a calibrated logistic regression over hashed word and character n-grams.

The regression learns from labelled rows (labels.quality), a bounded sample of them: about `SAMPLE_DOCS`
documents of each class by a hash of the id, a fifth of which only calibrate its probabilities, weighted to
the classes' shares of all labelled rows, so that a sample of another mix gives the same probabilities.
Scoring is done in Arrow batches against the fixed thresholds.

Defined results: null text has no words (so it fails the base rules); labels that are null, or whose
document is absent, teach nothing; of several labels of a document the lower one counts; without rows of both
classes every probability is 1 and the base rules decide alone; a probability at the threshold is kept;
repeated rows get a row each; other columns are ignored; an empty table gives no rows. Very long texts are
counted and scored whole, in memory of some 60 bytes for each of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, pieces_of, prepare
from .linear import Scorer, calibrate, features, train
from .textstats import counts

SAMPLE_DOCS = 1500
#: A text is kept at this calibrated probability of good quality or more.
LEAST_GOOD = 0.5
#: Rows of a sample that go to the driver at most.
MOST_ROWS = 8 * SAMPLE_DOCS
#: The base rules' bounds.
LEAST_WORDS, REPEAT_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def sparse_rows(labelled: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Features, target, weight and fold of a sample (doc_id, text, target, weight) on the driver, of at most MOST_ROWS rows.

    Samples are drawn by ids and hold some SAMPLE_DOCS rows a class; only where one id has very many rows do they
    pass the bound, and rows of the lowest hashes of id and text are taken then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), *batch.columns[1:]], names=["keys", "values", "target", "weight", "fold"])

    fold = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(5))
    rows = labelled.orderBy(F.xxhash64(F.lit(23), "doc_id", "text"), "target").limit(MOST_ROWS).select(F.col("text").cast("string").alias("text"), F.col("target").cast("double").alias("target"), F.col("weight").cast("double").alias("weight"), fold.cast("bigint").alias("fold"))
    table = rows.mapInArrow(run, "keys array<int>, values array<float>, target double, weight double, fold bigint").toArrow().combine_chunks()
    split = lambda name: [x.values.to_numpy() for x in table.column(name)]
    return split("keys"), split("values"), *(table.column(name).to_numpy() for name in ("target", "weight", "fold"))


def fit_rows(labelled: DataFrame) -> Scorer | None:
    """Train on four fifths of a bounded labelled frame, classes in balance, and calibrate on the rest, each row by its weight."""
    keys, values, target, weight, fold = sparse_rows(labelled)
    some = np.array([len(k) > 0 for k in keys], bool)
    learn, rest = np.flatnonzero((fold > 0) & some), np.flatnonzero((fold == 0) & some)
    good = target[learn].sum() if len(learn) else 0
    if not 0 < good < len(learn):
        return None
    even = target[learn] / good + (1 - target[learn]) / (len(learn) - good)
    scorer = train([keys[i] for i in learn], [values[i] for i in learn], target[learn], even)
    margin = np.array([(scorer.weights[keys[i]] * values[i]).sum() + scorer.bias for i in rest])
    return calibrate(scorer, margin, (target[rest] > 0.5).astype(float), weight[rest])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Scorer | None:
    """Learn from documents (doc_id, text) and labels (doc_id, quality of 0 or 1)."""
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("quality") == 1, min(1.0, sample_docs / sizes[1])).otherwise(min(1.0, sample_docs / sizes[0]))
    chance = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.where(chance < share).groupBy("doc_id").agg(F.min_by(F.struct(F.col("quality").alias("target"), (1 / share).alias("weight")), "quality").alias("label")).select("doc_id", "label.*")
    # The sample holds about 2 * sample_docs rows at any size of input.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    return fit_rows(rows)


def judge(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """For documents (doc_id, text): the base counts, base_failed, kept, probability."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(scorer)  # a fixed number of weights
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            text = batch.column(1).fill_null("")
            for low, high in pieces_of(text):
                part = text.slice(low, high - low)
                base = counts(*bytes_of(part))
                n = base["n_words"]
                failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * n)
                good = scorer.probabilities(part) if scorer else np.ones(high - low)
                columns = [batch.column(0).slice(low, high - low), *(pa.array(base[k]) for k in BASE), pa.array(failed), pa.array(~failed & (good >= LEAST_GOOD)), pa.array(good)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept", "probability"])

    schema = f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in BASE) + ", base_failed boolean, kept boolean, probability double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
