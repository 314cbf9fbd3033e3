"""Language identification with language-bitmask n-gram filters.

For each learned language, the character n-grams that are typical of it go into one Bloom filter. The
filters are bit-sliced: a slot holds a mask with a bit for each language, in as many 64-bit words as the
languages need, so one look at a slot asks all languages at once, and the AND of an n-gram's slots is the mask of all languages that may contain it. A
text's score for a language is the share of its n-grams whose mask has the language's bit, corrected for
the false positives that the filter's fill lets through.

Learning uses a bounded sample (`SAMPLE_DOCS` documents a language, by a hash of the id) of the documents
that are not held out. An n-gram belongs to a language if at least `LEAST_SHARE` of its sampled documents
hold it, and no other language's share is over `LEAD` times as high. The number of such n-grams is at most
the mean number of n-grams in a document over `LEAST_SHARE`, for any size of corpus.

Defined results: null text, and text without a letter, is `und` with score 0; with nothing learned
(no rows, or no labelled ones) every text is `und`; null ids are never held out and never learned from;
repeated rows get a row each; other columns are ignored; an empty table gives no rows. Equal scores go to the
first language in order, so a text with letters of which no n-gram is known has score 0 and that language.
Very long texts are scored whole, in memory of some 100 bytes for each of theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mixed, pieces_of, prepare, release

SAMPLE_DOCS, LEAST_SHARE, LEAD = 1500, 0.02, 4.0
#: Lengths of n-grams in bytes of lower-cased UTF-8 text; hash functions; slots of the filters.
SIZES, HASHES, SLOT_BITS = (2, 3, 4), 2, 21


@dataclass
class Model:
    """slots: one row for each 64 languages, in order."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def simplified(texts: pa.Array) -> pa.Array:
    """Lower case, with runs of anything but letters as one space: n-grams then speak of words and their ends."""
    import pyarrow.compute as pc

    low = pc.binary_join_element_wise(" ", pc.utf8_lower(texts), " ", "")
    return pc.replace_substring_regex(low, pattern=r"[^\pL]+", replacement=" ")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of simplified texts, and the number of the text of each."""
    data, at = bytes_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    codes, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[k : k + m].astype(np.uint64)
        whole = owner[:m] == owner[n - 1 :]
        codes.append(code[whole])
        owners.append(owner[:m][whole])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mixed(np.concatenate(codes)), np.concatenate(owners)


def slots_of(code: np.ndarray) -> list[np.ndarray]:
    """The filter slots of hashed n-grams."""
    return [(code >> np.uint64(64 - SLOT_BITS * (k + 1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from documents (doc_id, text, lang) that are not held out."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / sizes[k]))))
    chance = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(F.col("lang").isin(languages) & (chance < F.element_at(share, F.col("lang")))).select("lang", F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each task: in how many of a language's documents each n-gram is; code -1 counts the documents."""
        release()
        seen: dict[str, list[np.ndarray]] = {}
        docs_in: dict[str, int] = {}
        for batch in batches:
            text, lang = simplified(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
            for low, high in pieces_of(text):
                code, owner = grams(text.slice(low, high - low))
                order = np.lexsort((code, owner))
                code, owner = code[order], owner[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
                code, own = code[new], lang[low:high][owner[new]]
                for k in set(lang[low:high].tolist()):
                    seen.setdefault(k, []).append(code[own == k])
                    docs_in[k] = docs_in.get(k, 0) + int((lang[low:high] == k).sum())
        for k, parts in seen.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(code) + 1)), pa.array(np.append(code.view(np.int64), -1)), pa.array(np.append(n, docs_in[k]).astype(np.int64)), pa.array([False] * len(code) + [True])], names=["lang", "code", "n", "total"])

    counted = sample.mapInArrow(count, "lang string, code bigint, n bigint, total boolean").groupBy("lang", "code", "total").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counted.where("total").collect()}
    if not totals:
        return Model([], np.zeros((0, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    of = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, float(n))))
    rated = counted.where(~F.col("total")).withColumn("share", F.col("n") / F.element_at(of, F.col("lang")))
    best = rated.groupBy("code").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("of")).where(F.col("best") >= LEAST_SHARE)
    kept = best.select("code", F.transform(F.filter("of", lambda x: (x["share"] >= LEAST_SHARE) & (x["share"] * LEAD >= F.col("best"))), lambda x: x["lang"]).alias("langs"))
    table = kept.toArrow()
    bit = {k: i for i, k in enumerate(languages)}
    masks = [sum(1 << bit[k] for k in x) for x in table.column("langs").to_pylist()]
    code = table.column("code").to_numpy().view(np.uint64)
    slots = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    for w, word in enumerate(slots):
        part = np.array([m >> 64 * w & (1 << 64) - 1 for m in masks], np.uint64)
        for at in slots_of(code):
            np.bitwise_or.at(word, at, part)
    fill = np.array([(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, slots, fill**HASHES)


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the number of its language, -1 for none, and that language's corrected share."""
    n_docs, n_langs = len(texts), len(model.languages)
    best, score = np.full(n_docs, -1), np.zeros(n_docs)
    if not n_langs:
        return best, score
    text = simplified(texts)
    for low, high in pieces_of(text, 1 << 18):
        code, owner = grams(text.slice(low, high - low))
        if not len(code):
            continue
        a, *rest = slots_of(code)
        total = np.bincount(owner, minlength=high - low)
        hits = np.zeros((high - low, n_langs), np.int64)
        for w, word in enumerate(model.slots):
            mask = word[a]
            for at in rest:
                mask &= word[at]
            for i in range(64 * w, min(64 * w + 64, n_langs)):
                hits[:, i] = np.bincount(owner[mask >> np.uint64(i % 64) & np.uint64(1) > 0], minlength=high - low)
        share = hits / np.maximum(total, 1)[:, None]
        # A filter that is full says yes to everything, and tells nothing.
        share = np.clip((share - model.false_rate) / np.maximum(1 - model.false_rate, 1e-9), 0, 1)
        top = share.argmax(1)
        lettered = total > 0
        best[low:high] = np.where(lettered, top, -1)
        score[low:high] = np.where(lettered, share[np.arange(high - low), top], 0)
    return best, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of documents (with a column text), and lang_pred, lang_score in front of them."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of slots for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in batches:
            text = batch.column(0)
            best, score = scores(model, text.fill_null(""))
            # A text of marks only simplifies to a space, which holds no n-gram.
            names = pa.array([model.languages[i] if i >= 0 else "und" for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(score), *batch.columns[1:]], names=["lang_pred", "lang_score", *batch.schema.names[1:]])

    rest = [f"_{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*rest)
    inner = inner.select(F.col(rest[docs.columns.index("text")]).cast("string").alias("_t"), *rest)
    schema = "lang_pred string, lang_score double, " + ", ".join(f"{n} {kind}" for n, (_, kind) in zip(rest, docs.dtypes, strict=True))
    return inner.mapInArrow(run, schema).toDF("lang_pred", "lang_score", *docs.columns)
