"""Enumeration of candidate words and the sequences that they emit.

Charge and motifs depend on a residue's class alone, so the space is walked over seven classes instead of
twenty residues (7 ** w words), filtered there, and only class words that emit are spread out to residues.
A word's number in the enumeration over residues travels with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.residues import ALPHABET, MOTIFS, TABLE_CHARGE
from ..functions.sequence import doubled, mirrored, motif_score, table_charge_tenths

#: Residues that no rule tells apart; a class's first residue stands for it.
CLASSES = ("L", "R", "V", "K", "DE", "H", "GAIPFYWSTCMNQ")
LEAST_CHARGE, MOST_CHARGE, MOTIF_OVER = 30, 70, 1


def words(spark: SparkSession, w: int, start: int = 1, end: int | None = None) -> DataFrame:
    """num (from 1, in enumeration order), word: words numbered start to end of all 20 ** w."""
    size = len(ALPHABET)
    end = size**w if end is None else min(end, size**w)
    numbers = spark.range(max(start, 1), max(end + 1, 1)).withColumnRenamed("id", "num")
    return numbers.select("num", _decode(F.col("num") - 1, w, ALPHABET).alias("word"))


#: Residues whose windows are numbered at once, and the most words whose counts a task holds.
AT_ONCE, COUNTED = 1 << 20, 1 << 20


def _codes(column: pa.Array, raw: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in the alphabet of the bytes of a column of texts, and where each text starts in them, with the end of the last.

    What is no residue has the place 20; of raw texts it is left out, and small letters are as capitals."""
    texts = column.cast(pa.large_string()).fill_null("")
    places = np.full(256, len(ALPHABET), np.uint8)
    for letters in (ALPHABET, ALPHABET.lower()) if raw else (ALPHABET,):
        places[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(ALPHABET))
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    codes = places[np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]] if data else np.empty(0, np.uint8)
    starts = starts - starts[0]
    if raw:
        kept = codes < len(ALPHABET)
        return codes[kept], np.concatenate(([0], np.cumsum(kept)))[starts]
    return codes, starts


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.concatenate((numbers[:1] == numbers[:1], numbers[1:] != numbers[:-1]))]


def _windows(codes: np.ndarray, starts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of w residues of the alphabet that lie within one text, and the text of each."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = max(len(codes) - w + 1, 0)
    other = np.concatenate(([0], np.cumsum(codes == len(ALPHABET))))
    at = np.flatnonzero((text[:n] == text[len(text) - n :]) & (other[w:][:n] == other[:-w][:n]))
    return at, text[at]


def _may_pass(codes: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Of windows those whose twins have a charge within the bounds and whose mirrored or doubled word has any motif: all that `passes`, and few others."""
    tenths = np.array([TABLE_CHARGE.get(r, 0) for r in ALPHABET] + [0], np.int64)
    total = np.concatenate(([0], np.cumsum(tenths[codes])))
    at = at[((charge := 2 * (total[at + w] - total[at])) >= LEAST_CHARGE) & (charge <= MOST_CHARGE)]
    # Motifs are words of few residues: one digit for each of these, 0 for the others.
    motifs = [m for ms in MOTIFS.values() for m in ms]
    letters, size = sorted({c for m in motifs for c in m}), len(motifs[0])
    digit = np.array([letters.index(r) + 1 if r in letters else 0 for r in ALPHABET] + [0], np.int64)
    known = np.zeros((len(letters) + 1) ** size, bool)
    for m in motifs:
        known[sum((letters.index(c) + 1) * (len(letters) + 1) ** (size - 1 - k) for k, c in enumerate(m))] = True
    places, any_motif = list(range(w)), np.zeros(len(at), bool)
    digits = digit[codes]
    for twin in (places + places[::-1], places + places):
        for k in range(2 * w - size + 1):
            number = np.zeros(len(at), np.int64)
            for p in twin[k : k + size]:
                number = number * (len(letters) + 1) + digits[at + p]
            any_motif |= known[number]
    return at[any_motif]


def _numbers_in(w: int, counted: bool, promising: bool, raw: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of sequences to (num, texts): words of length w and in how many sequences of a part of the task they are (where not counted, any number).

    A part is some sequences of AT_ONCE residues together, or one longer; where there are few words, the task's sums are one batch."""
    size = len(ALPHABET)
    words_of_all = size**w
    most = max(1, (2**63 - 1) // words_of_all)

    def batch(num: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(num + 1), pa.array(texts.astype(np.int64))], ["num", "texts"])

    def part(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, text = _windows(codes, starts, w)
        if promising:
            at = _may_pass(codes, at, w)
        num = np.zeros(len(at), np.int64)
        for p in range(w):
            num = num * size + codes[at + p]
        if counted:
            num = _distinct(text * words_of_all + num) % words_of_all
        return np.unique(num, return_counts=True) if words_of_all > COUNTED else (num, np.ones(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(words_of_all if words_of_all <= COUNTED else 0, np.int64)
        for given in batches:
            codes, starts = _codes(given.column(0), raw)
            low = 0
            while low < len(starts) - 1:
                high = int(np.searchsorted(starts, starts[low] + AT_ONCE, "right")) - 1
                high = min(max(high, low + 1), low + most, len(starts) - 1)
                num, texts = part(codes[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
                low = high
                if len(sums):
                    sums += np.bincount(num, minlength=len(sums))
                elif len(num):
                    yield batch(num, texts)
        if len(sums):
            yield batch(np.flatnonzero(sums), sums[sums > 0])

    return run


def words_in(df: DataFrame, w: int, seq: str = "seq", start: int = 1, end: int | None = None) -> DataFrame:
    """num, word, texts: the words of length w in sequences of the alphabet, their numbers in the enumeration (from start to end), and how many sequences hold each.

    Windows are numbered and made distinct where a sequence lies, some sequences at once; only numbers and counts are
    shuffled, and combined before."""
    found = df.select(seq).mapInArrow(_numbers_in(w, True, False), "num long, texts long")
    chosen = found.where(F.col("num").between(start, len(ALPHABET) ** w if end is None else end)).groupBy("num").agg(F.sum("texts").alias("texts"))
    return chosen.select("num", _decode(F.col("num") - 1, w, ALPHABET).alias("word"), "texts")


def distinct_words_in(df: DataFrame, w: int, seq: str = "seq", promising: bool = False, raw: bool = False) -> DataFrame:
    """num, word: the distinct words of length w in sequences of the alphabet, or in the residues of raw texts; promising ones are those that may pass the charge and motif rules, told before the shuffle."""
    found = df.select(seq).mapInArrow(_numbers_in(w, False, promising, raw), "num long, texts long")
    return found.select("num").distinct().select("num", _decode(F.col("num") - 1, w, ALPHABET).alias("word"))


def emitted(found: DataFrame, emit_tested: bool = False) -> DataFrame:
    """num, branch, seq that rows (num, word) emit."""
    return emit(found.select("num", "word", passes(F.col("word")).alias("ok")).where("ok.mirror or ok.double"), emit_tested)


def _decode(number: Column, w: int, letters: str) -> Column:
    size = len(letters)
    return F.concat(*(F.substring(F.lit(letters), (F.floor(number / F.lit(size ** (w - 1 - p))).cast("bigint") % size + 1).cast("int"), F.lit(1)) for p in range(w)))


def passes(word: Column) -> Column:
    """Struct of whether the mirrored and the doubled word meet the charge and motif rules.

    The words are bound to names by one-element arrays, so that they are built once and not in every count."""

    def meets(s: Column) -> Column:
        return table_charge_tenths(s).between(LEAST_CHARGE, MOST_CHARGE) & (motif_score(s) > MOTIF_OVER)

    def bound(x: Column) -> Column:
        return F.element_at(F.transform(F.array(x), meets), 1)

    return F.element_at(F.transform(F.array(word), lambda w: F.struct(bound(mirrored(w)).alias("mirror"), bound(doubled(w)).alias("double"))), 1)


def emit(found: DataFrame, emit_tested: bool = False) -> DataFrame:
    """num, branch, seq of rows (num, word, ok from `passes`): a row for each rule that a word passes.

    Both branches emit the doubled word, unless the tested one is asked for."""
    branches = F.filter(F.array(F.when(F.col("ok.mirror"), F.lit("mirror")), F.when(F.col("ok.double"), F.lit("double"))), lambda x: x.isNotNull())
    rows = found.select("num", "word", F.explode(branches).alias("branch"))
    seq = F.when(F.col("branch") == "mirror", mirrored(F.col("word"))).otherwise(doubled(F.col("word"))) if emit_tested else doubled(F.col("word"))
    return rows.select("num", "branch", seq.alias("seq"))


def candidates(spark: SparkSession, w: int, start: int = 1, end: int | None = None, emit_tested: bool = False, distinct: bool = False) -> DataFrame:
    """num, branch, seq of all emitted sequences, composition first."""
    firsts = "".join(c[0] for c in CLASSES)
    classes = spark.range(len(CLASSES) ** w).select(_decode(F.col("id"), w, firsts).alias("kind"))
    kept = classes.select("kind", passes(F.col("kind")).alias("ok")).where("ok.mirror or ok.double").withColumn("num", F.lit(0).cast("bigint"))
    for p in range(w):
        members = reduce(lambda rest, c: F.when(F.substring("kind", p + 1, 1) == c[0], F.array(*(F.lit(ALPHABET.index(r)) for r in c))).otherwise(rest), CLASSES, F.array().cast("array<int>"))
        kept = kept.withColumn("digit", F.explode(members)).select("kind", "ok", (F.col("num") * 20 + F.col("digit")).alias("num"))
    if start > 1 or end is not None:
        kept = kept.where(F.col("num").between(start - 1, (20**w if end is None else end) - 1))
    out = emit(kept.select((F.col("num") + 1).alias("num"), _decode(F.col("num"), w, ALPHABET).alias("word"), "ok"), emit_tested)
    return out.dropDuplicates(["seq"]) if distinct else out
