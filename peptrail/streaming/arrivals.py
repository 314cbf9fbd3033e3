"""Candidates that arrive as files of lines: descriptors and rules on the stream, the same columns as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequence import REGISTRY, motif_score, table_charge_tenths
from ..sources.candidates import LEAST_CHARGE, MOST_CHARGE, MOTIF_OVER


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """seq of every new line of a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.rtrim(F.col("value")).alias("seq"))


def described(stream: DataFrame) -> DataFrame:
    """Sequences that meet the charge and motif rules, with their descriptors."""
    seq = F.col("seq")
    kept = stream.where(table_charge_tenths(seq).between(LEAST_CHARGE, MOST_CHARGE)).where(motif_score(seq) > MOTIF_OVER)
    return kept.select("seq", *(build(seq).alias(name) for name, build in REGISTRY.items()))


def store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each file of input once, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
