"""Writers. Distributed by default; `single` gathers a bounded result, such as a top list, in one file."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


#: Texts keep their spaces, quotes are doubled and backslashes plain; an empty text is quoted, a missing one is bare. `readers.CSV` reads it.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode(mode).options(**CSV).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def ranked_csv(ranked: DataFrame, path: str) -> None:
    """Seqs, score of a ranked top list, in order."""
    write_csv(ranked.select(F.col("seq").alias("Seqs"), "score"), path, single=True)


def final_csv(final: DataFrame, path: str) -> None:
    """Seqs, MIC, score of the final list, in order."""
    write_csv(final.select(F.col("seq").alias("Seqs"), F.col("mic").alias("MIC"), "score"), path, single=True)


def append_cache(cache_path: str, new: DataFrame) -> None:
    """Add embeddings (seq, embedding) that the cache lacks; the caller passes misses only."""
    new.select("seq", "embedding").write.mode("append").parquet(cache_path)


def parameters(best: dict[str, object], spark) -> DataFrame:
    """param, value rows."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(best.items())], "param string, value string")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the folder that driver and executors share; a temporary one where none is set (tests)."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="peptrail-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stamped(name: str, at: datetime) -> str:
    """A name with the second in it: name_20240131_235959."""
    return f"{name}_{at:%Y%m%d_%H%M%S}"


def snapshot(df: DataFrame, folder: str, name: str, at: datetime) -> str:
    """Write a curated table as CSV under a stamped name; the path."""
    path = f"{folder}/{stamped(name, at)}"
    write_csv(df, path)
    return path


def report(sections: dict[str, DataFrame], folder: str, name: str, at: datetime) -> str:
    """Write small metric tables as one text under a stamped name: a title, the column names and a line for each row; the path.

    Lines are numbered by section and gathered in one file, as reports are short."""
    parts = []
    for k, (title, df) in enumerate(sections.items()):
        cells = [F.coalesce(F.when(F.lit(kind in ("double", "float")), F.format_string("%.4f", F.col(c).cast("double"))).otherwise(F.col(c).cast("string")), F.lit("")) for c, kind in df.dtypes]
        head = df.sparkSession.createDataFrame([(k, 0, f"# {title}"), (k, 1, "\t".join(df.columns))], "section int, line int, value string")
        parts.append(head.union(df.select(F.lit(k).alias("section"), F.lit(2).alias("line"), F.concat_ws("\t", *cells).alias("value"))))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.union(more)
    path = f"{folder}/{stamped(name, at)}"
    whole.repartition(1).sortWithinPartitions("section", "line", "value").select("value").write.text(path)
    return path
