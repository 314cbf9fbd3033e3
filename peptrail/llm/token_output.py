"""Token ids as Parquet list columns, in ascending document order, with indexes for selective reads.

A file holds shard, start_in_shard, doc_id, n_tokens and ids. Ids are dictionary-encoded (two bytes for a
vocabulary of up to 65,536) and compressed; row groups and pages are kept small, and the writer adds page
indexes, so that a reader of some documents, or of the small columns only, skips the ids of the rest.

Defined results: null text is empty text, which is the end id alone; null ids sort first; equal ids keep
a row each, in the order of the input, and may lie in several shards; other columns are ignored; an empty
table gives no rows. Very long texts are encoded whole, as one list in one row group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare
from .tokens import default_tokenizer, encoder

#: Bytes of ids for a row group and a page. A shard is about as large as an input partition.
GROUP_BYTES, PAGE_BYTES = 8 << 20, 256 << 10


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode documents (doc_id, text), append the end id to each, and write them in ascending doc_id order."""
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or default_tokenizer()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # Rows of one id, however many, are parted by their number.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = encoder(tokenizer).encode, 0
        for batch in batches:
            ids, at = encode(batch.column(1), end_id)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], names=["doc_id", "start_in_shard", "n_tokens", "ids"])
            start += int(at[-1])

    kind = dict(docs.dtypes)["doc_id"]
    out = ordered.mapInArrow(run, f"doc_id {kind}, start_in_shard bigint, n_tokens bigint, ids array<int>")
    out = out.select(F.spark_partition_id().alias("shard"), *out.columns)
    writer = out.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    writer.option("parquet.enable.dictionary", "true").option("parquet.page.row.count.limit", 1000).parquet(path)


def read(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Documents of the files, with their ids; a filter on doc_id or shard reaches row groups and pages."""
    files = spark.read.parquet(path)
    return files if where is None else files.where(where)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Where each shard begins in the whole stream of ids: shard, base. Reads the two small columns only."""
    totals = read(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = read(spark, path).select("shard", "doc_id", "start_in_shard", "ids")
    kind = dict(files.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B") if len(lists.values) else b""
            codes = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(codes, pa.int64())], names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"])

    coded = files.mapInArrow(run, f"shard int, doc_id {kind}, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint")
    return coded.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
