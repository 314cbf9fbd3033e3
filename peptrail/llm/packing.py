"""Best-fit packing of token sequences by minimum bin slack.

Which pieces share a sequence depends on their lengths alone, so the plan is made from the histogram of
lengths (at most `capacity` numbers): each step opens a bin with the longest length left and finds, by a
subset-sum bitset over the lengths that are left, the fullest combination that fits beside it. The
combination is taken as often as its lengths allow, after which fewer of one length are left than it
needed; so a plan has at most the sum of capacity / length steps, however many documents there are. Spark numbers the pieces of each length and
looks their places up in the plan.

Defined results: null text is empty text; an empty text is one piece holding only the end id; null or
repeated document ids are packed row by row; pieces of equal length keep the order in which they were
written down, so that places hold when a task runs again; other columns are ignored; an empty table gives
no rows. Very long texts are encoded whole by one task, and cut into pieces of `capacity` ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, unused
from .tokens import default_tokenizer, encoder

#: Rows of one numbering group; a group holds pieces of all lengths, so no length is numbered by one task.
GROUP_ROWS = 20_000


@dataclass
class Step:
    """One combination: how often it is taken, and the lengths in it, longest first."""

    times: int
    lengths: list[int]


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, available as often as counted, whose sum is the largest that is at most room."""
    mask, reach = (1 << (room + 1)) - 1, 1
    came: dict[int, tuple[int, int, int]] = {}
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            many = min(many, left)
            left -= many
            grown = (reach << (length * many)) & mask & ~reach
            reach |= grown
            while grown:
                low = grown & -grown
                s = low.bit_length() - 1
                came[s] = (s - length * many, length, many)
                grown ^= low
            many *= 2
        if reach >> room & 1:
            break
    out, s = [], reach.bit_length() - 1
    while s:
        s, length, many = came[s]
        out += [length] * many
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[Step]:
    """Minimum bin slack over a histogram of lengths."""
    left = {k: n for k, n in counts.items() if n > 0}
    steps = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        lengths = [longest, *fullest(capacity - longest, rest)]
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in need.items())
        steps.append(Step(times, lengths))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return steps


def segments(steps: list[Step]) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first sequence, offset), ascending; ranks count the pieces of a length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for step in steps:
        offset = 0
        for length in dict.fromkeys(step.lengths):
            copies = step.lengths.count(length)
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * step.times
            offset += copies * length
        sequence += step.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Only a document of more than `capacity` ids is cut; its first piece takes what is over whole pieces."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows, out = [], []
            ids, at = encode(batch.column(1), end_id)
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                low = a
                for piece, high in enumerate(range(a + (b - a - 1) % capacity + 1, b + 1, capacity)):
                    part = ids[low:high]
                    rows.append(row)
                    out.append((piece, low - a, high - low, zlib.crc32(part)) + ((part.astype("<i4"),) if with_ids else ()))
                    low = high
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(name for name, _ in fields)])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text) into as few sequences of at most `capacity` ids as minimum bin slack finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    prepare(docs.sparkSession)
    return place(cut_pieces(docs, capacity, tokenizer or default_tokenizer(), end_id, with_ids), capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (length of 1 to capacity, any other columns).

    Pieces get a number each and are written down with it: groups and places follow from the numbers, whatever
    ids the documents have."""
    row = unused(pieces, "_row")
    kept = cut(pieces.withColumn(row, F.monotonically_increasing_id()))
    rows = kept.count()
    groups = max(16, -(-rows // GROUP_ROWS))
    grouped = kept.withColumn("_group", F.pmod(F.xxhash64(row), F.lit(groups)).cast("int"))
    counts = grouped.groupBy("_group", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = segments(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_group", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_group", "length").orderBy(row)
    numbered = grouped.withColumn("_own", F.row_number().over(own) - 1)
    numbered = numbered.join(firsts, ["_group", "length"]).withColumn("_rank", F.col("_first") + F.col("_own"))
    numbered = numbered.select(*pieces.columns, F.col("_rank").cast("bigint").alias("_rank"))
    keys = (table[:, 0] << 44) + table[:, 1]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            found = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            over = rank - found[:, 1]
            columns = [*batch.columns[:-1], pa.array(found[:, 3] + over // found[:, 2]), pa.array(found[:, 4] + over % found[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)
