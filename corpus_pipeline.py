"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents. Between stages the rows are written as Parquet in the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import jaccard, langid, packing, pii, suffix_dedup
from peptrail.llm.common import new_folder, read, unused, with_key

#: A document whose best language explains fewer of its n-grams than this is no prose in a learned language.
LEAST_LANGUAGE_SCORE = 0.2

#: Language scores, hashing and bootstrapped spans have no SQL form; tests/llm compares operators with brute force, and checks the chain's columns, counts and a few texts.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that no learned language explains."""
    found = langid.predict(docs, langid.fit(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "lang_score")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near copies."""
    return jaccard.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document of a smaller id has; a document that is cut to nothing goes."""
    key, kept, gone = (unused(docs, name) for name in ("_key", "_kept", "_gone"))
    keyed = with_key(docs, key)
    cut = suffix_dedup.remove_repeats(keyed.select(F.col(key).alias("doc_id"), "text"), with_text=True)
    cut = cut.where("n_removed = 0 or n_removed < n_bytes").select(F.col("doc_id").alias(key), F.col("kept_text").alias(kept), F.col("n_removed").alias(gone))
    # Only columns beside the text, and whether it is null, meet the cut texts.
    rest = keyed.withColumn("text", F.col("text").isNull())
    joined = rest.join(cut, key).withColumn("text", F.when(~F.col("text"), F.col(kept)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hide personal data."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
