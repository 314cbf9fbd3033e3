"""What the text operators share: tables, the shared folder, Arrow batches in bounded pieces."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker turns into arrays at once; temporaries are some ten times as large.
PIECE_BYTES = 1 << 20

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Set what the operators rely on: workers find this package, Arrow batches are bounded by bytes, checkpoints have a place."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    shared_folder(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir():
        # The context's own folder has a part of its own below the folder that was set; it may be a URI.
        named = sc.getCheckpointDir().rstrip("/").rpartition("/")[0]
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="peptrail-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    Spark removes its files once nothing refers to it if spark.cleaner.referenceTracking.cleanCheckpoints is
    true when the context starts; else they stay until the shared folder's owner removes them."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_as_is(df: DataFrame) -> DataFrame:
    """As `cut`, and later joins and groups know how these rows are partitioned and sorted, so that they stay where they are.

    Under adaptive execution a checkpoint forgets its partitioning; it is off for this one step."""
    spark = df.sparkSession
    prepare(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def cut_by(df: DataFrame, parts: int, key: str) -> DataFrame:
    """As `cut_as_is`, with rows partitioned and sorted by a key; there is no choice to make at run time."""
    return cut_as_is(df.repartition(parts, key).sortWithinPartitions(key))


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished steps' shuffle files and checkpoints have no user left."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to a frame."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def with_key(docs: DataFrame, key: str = "_key") -> DataFrame:
    """Documents with a whole number for each row: the id where ids are whole, distinct and not null, else a number given once and written down."""
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        ids = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
        if not ids.take(1):
            return docs.withColumn(key, F.col("doc_id").cast("bigint"))
    return cut(docs.withColumn(key, F.monotonically_increasing_id()))


def trim() -> None:
    """Give freed memory back to the system: workers live on after a task, beside the executor's JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def release() -> None:
    """Drop what operators keep in this worker for their next task, such as encoders: workers live on, and the next work may be another's."""
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{__package__}."):
            for value in list(vars(module).values()):
                if hasattr(value, "cache_clear"):
                    value.cache_clear()
    trim()


def pieces_of(text: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes of text, or one row."""
    if not len(text):
        return
    sizes = np.diff(offsets_of(text))
    low = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    yield low, len(text)
    if total + low > 0 and len(text) > 100:
        trim()


def offsets_of(text: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array's values in its data buffer, len + 1 of them."""
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    kind = np.int64 if wide else np.int32
    if len(text) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array's values, end to end, and their offsets from 0. Nulls count as empty."""
    if text.null_count:
        text = text.fill_null("" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    at = offsets_of(text)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply), so that sums of powers become evenly spread hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1024), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


#: The bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts laid end to end: their starts, ends and, for each text, the first word's number (len + 1).

    Words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Masks that keep the first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def wide(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word at every place of some bytes and at the 8 after them, with zeros past the end."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def hashed_twice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of non-empty byte runs.

    Every 8-byte block is mixed with its place before blocks are summed, once for each hash, so that no
    algebra over the bytes (as that of polynomials) makes runs collide; both together stand for equality."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = ends - starts
    blocks = sizes + 7 >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    word = wide(data)[np.repeat(starts, blocks) + 8 * place] & FIRST_BYTES[np.minimum(np.repeat(sizes, blocks) - 8 * place, 8)]
    with np.errstate(over="ignore"):
        x = mixed(word + mixed(place.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        y = mixed(x ^ np.uint64(0x8CB92BA72F3D8DD7))
        n = sizes.astype(np.uint64)
        return mixed(np.add.reduceat(x, first) + n), mixed(np.add.reduceat(y, first) ^ n)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte runs."""
    return hashed_twice(data, starts, ends)[0]
