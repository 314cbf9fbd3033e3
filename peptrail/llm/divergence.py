"""How far sources of a language are apart in their words: exact whole-number divergences of all pairs, and the words that set a source off.

Terms are counted in Arrow batches, and counts of equal (lang, source, term) are combined before they are
shuffled. A language keeps the terms of at least LEAST_DOCS of its documents. A group's share of a term is
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), whole numbers throughout; two shares differ by
floor((p - q) ** 2 / (p + q)), and two groups by the sum of that over all kept terms.

Pairs are summed by a split of the terms, over V times the difference of two absent shares, which is the sum
if both groups lacked all terms. Heavy terms, those of more than LIGHT groups of their language, fill dense
tiles: two blocks of BLOCK sources by a bucket of terms, with the absent share where a source lacks one. Of light
terms no pair of groups is visited but those that share one: each term of either group adds a difference (a
histogram of a group's shares tells, in the same tiles), and each pair in a term's short posting list is
corrected. All parts are whole numbers, so their sum is exact.

Defined results: null text, lang and source are ''. A group without terms is there, with shares of absent terms
only. A language without kept terms has 0 for every pair and no term. A language with one source has no pairs.
Equal documents count each. Other columns, ids included, are ignored; an empty table has no rows. A text of any
length is counted whole by one task. Sums fit 63 bits up to some 10 ** 9 kept terms of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, pieces_of, prepare

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: A term of at most so many groups of its language is light: its pairs, at most LIGHT ** 2 / 2, are corrected one by one.
LIGHT = 8
#: Sources in a block of a tile, and about as many terms in a bucket; a tile's numbers are at most 2 * BLOCK * TERMS.
BLOCK, TERMS = 64, 4096
#: Light rows that one task corrects at once, about.
LIGHT_ROWS = 200_000

#: Bytes of terms (ASCII letters and all of other characters), and bytes with A-Z lower-cased.
INSIDE = np.zeros(256, bool)
INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Terms of texts laid end to end, lower-cased, and the number of the text that each is in."""
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    # Bytes of terms stay in order, so a term begins where as many bytes of terms lie before it.
    before = np.cumsum(inside)
    offsets = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[inside]]))
    return words, np.searchsorted(at, starts, side="right") - 1


def _count(groups: np.ndarray, text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """group, term, occurrences and documents of each term of each group, over some texts."""
    words, owner = terms_of(*bytes_of(text))
    if not len(words):
        return np.zeros(0, np.int64), words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    codes, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
    in_doc, times = np.unique(owner * n + codes, return_counts=True)
    key, place = np.unique(groups[in_doc // n] * n + in_doc % n, return_inverse=True)
    return key // n, coded.dictionary.take(pa.array(key % n)), np.bincount(place, times).astype(np.int64), np.bincount(place).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, text = batch.columns
            # Numbers of (lang, source) in the batch.
            one, two = lang.dictionary_encode(), source.dictionary_encode()
            both = np.asarray(one.indices).astype(np.int64) * len(two.dictionary) + np.asarray(two.indices)
            for a, b in pieces_of(text, 4 << 20):
                group, term, n, docs_with = _count(both[a:b], text.slice(a, b - a))
                names = one.dictionary.take(pa.array(group // len(two.dictionary))), two.dictionary.take(pa.array(group % len(two.dictionary)))
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(n), pa.array(docs_with)], names=["lang", "source", "term", "n", "docs"])

    each = docs.select(*map(empty, ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 terms)), in decimals, as SCALE times a count may pass 63 bits; null where nothing is kept."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)) of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def model(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, number, block, base, terms), numbered in their language, and their kept terms (lang, source, number, block, base, term, n, p, q, groups).

    base is the share of an absent term, q the language's share, groups the term's groups."""
    seen = cut(counts(docs))
    kept = seen.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("groups"))
    kept = cut(kept.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    rows = cut(seen.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint")
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", number.alias("number"), *map(zero, ("total", "terms", "lang_total")))
    groups = groups.withColumn("block", F.expr(f"number div {BLOCK}")).withColumn("base", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(1)))
    groups = cut(groups)
    shared = rows.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return groups, cut(shared.select("lang", "source", "number", "block", "base", "term", "n", p.alias("p"), q.alias("q"), "groups"))


def term_part(words: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of the terms that set a group off most."""
    over = words.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS)


def _tile(table: pa.Table) -> pa.Table:
    """Sums of the pairs of one tile: a, b (numbers, a < b), value.

    A row's kind says what it is. 0: a source, its absent share p, and, in the first bucket, all n terms of its
    language. 1: a share p of n light terms of a source. 2: a source's share p of a heavy term."""
    low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
    kind, number, p, n = (np.asarray(table.column(c)) for c in ("kind", "number", "p", "n"))
    sources = np.unique(number[kind == 0])
    at = np.searchsorted(sources, number)
    base, every, block = (np.zeros(len(sources), np.int64) for _ in range(3))
    base[at[kind == 0]], every[at[kind == 0]] = p[kind == 0], n[kind == 0]
    block[at] = np.asarray(table.column("block"))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    # All terms as if both sources lacked them; then what the terms that are there add over that.
    absent = _apart(base[:, None], base[right][None, :])
    total = every[:, None] * absent
    # Heavy terms: a dense row for each source, one source of the left block against the right block at a time.
    heavy = kind == 2
    terms = table.column("term").filter(pa.array(heavy)).combine_chunks().dictionary_encode()
    column, width = np.asarray(terms.indices), len(terms.dictionary)
    dense = np.repeat(base[:, None], width, axis=1)
    dense[at[heavy], column] = p[heavy]
    for i in left:
        total[i] += _apart(dense[i], dense[right]).sum(axis=1) - width * absent[i]
    # Light terms, by the histogram of a source's shares.
    place = np.full(len(sources), -1)
    place[right] = np.arange(len(right))
    for k in np.flatnonzero(kind == 1).tolist():
        i = at[k]
        if block[i] == low:
            total[i] += n[k] * (_apart(p[k], base[right]) - absent[i])
        if block[i] == high:
            total[left, place[i]] += n[k] * (_apart(p[k], base[left]) - absent[left, place[i]])
    a, b = np.repeat(sources[left], len(right)), np.tile(sources[right], len(left))
    value, ordered = total[left].ravel(), a < b
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * int(ordered.sum()), pa.string()), "a": a[ordered], "b": b[ordered], "value": value[ordered]})


def _correct(table: pa.Table) -> pa.Table:
    """For pairs of groups in the postings of light terms, what the term's true difference is over the sum of both alone: a, b, value."""
    term = np.asarray(table.column("term").combine_chunks().dictionary_encode().indices)
    number, base, p = (np.asarray(table.column(c)) for c in ("number", "base", "p"))
    order = np.lexsort((number, term))
    term, number, base, p = term[order], number[order], base[order], p[order]
    found, step = [np.zeros((3, 0), np.int64)], 1
    while len(i := np.flatnonzero(term[step:] == term[:-step])):
        j, step = i + step, step + 1
        value = _apart(p[i], p[j]) - _apart(p[i], base[j]) - _apart(base[i], p[j]) + _apart(base[i], base[j])
        found.append(np.stack((number[i], number[j], value)))
    a, b, value = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    sums = np.add.reduceat(value, first) if len(first) else value
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(first), pa.string()), "a": a[first], "b": b[first], "value": sums})


def pair_part(groups: DataFrame, words: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of all other sources of a group's language."""
    heavy, light = words.where(F.col("groups") > LIGHT), words.where(F.col("groups") <= LIGHT)
    sizes = words.agg(F.count_if(F.col("groups") <= LIGHT), F.approx_count_distinct(F.when(F.col("groups") > LIGHT, F.col("term")))).first()
    buckets, light_buckets = sizes[1] // TERMS + 1, sizes[0] // LIGHT_ROWS + 1
    # A block meets every block of its language, itself included: tiles are (lower, higher).
    blocks = groups.groupBy("lang").agg(F.max("block").alias("last"))
    none = F.lit("")
    tile = lambda df, kind, bucket, term, p, n: df.select("lang", "block", bucket.cast("int").alias("bucket"), F.lit(kind).alias("kind"), "number", term.alias("term"), p.alias("p"), n.alias("n"))
    every = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    all_terms = F.when(F.col("bucket") == 0, F.col("terms")).otherwise(0).cast("bigint")
    histogram = light.groupBy("lang", "block", "number", "p").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        tile(every, 0, F.col("bucket"), none, F.col("base"), all_terms)
        .unionByName(tile(histogram, 1, F.lit(0), none, F.col("p"), F.col("n")))
        .unionByName(tile(heavy, 2, F.pmod(F.xxhash64("term"), F.lit(buckets)), F.col("term"), F.col("p"), F.lit(0).cast("bigint")))
    )
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("other")
    placed = rows.join(blocks, "lang").select("*", other).select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "bucket", "block", "kind", "number", "term", "p", "n")
    sums = "lang string, a bigint, b bigint, value bigint"
    tiles = placed.groupBy("lang", "low", "high", "bucket").applyInArrow(_tile, sums)
    postings = light.where("groups > 1").select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(light_buckets)).alias("bucket"), "number", "base", "p")
    corrected = postings.groupBy("lang", "bucket").applyInArrow(_correct, sums)
    pairs = cut(tiles.unionByName(corrected).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("number"), F.col("b").alias("to")), F.struct(F.col("b").alias("number"), F.col("a").alias("to"))))
    names = groups.select("lang", "source", "number")
    both = pairs.select("lang", "value", ends.alias("e")).select("lang", "value", "e.*")
    both = both.join(names, ["lang", "number"]).join(names.select("lang", F.col("source").alias("item"), F.col("number").alias("to")), ["lang", "to"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", "item", "value", rank.alias("rank"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    prepare(docs.sparkSession)
    groups, words = model(docs)
    parts = {"pair": pair_part(groups, words), "term": term_part(words)}
    one, two = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in parts.items())
    return one.unionByName(two)
