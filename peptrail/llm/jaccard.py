"""Similarity join of documents on word n-gram sets, by MinHash banding.

1. Every text becomes the set of its hashed word 5-grams (a shorter text with words is one gram). Texts of
   equal sets are one class of copies and stand as one row from here on.
2. A signature of MinHash values, cut in bands whose count and rows are chosen for a target recall, is
   shuffled on band hashes. A bucket links its members to its least member; the linked classes form blocks
   of candidates, found as connected components of light rows, and no pair is written out.
3. In each block the full sets are compared: members are sorted by size and dealt into tiles, bounded by
   rows and by grams, and tiles meet only where sizes allow the threshold. A pair counts if its exact Jaccard similarity reaches the
   threshold, whether or not it shares a band. A tile reports numbers of links and its components as stars, not pairs.
4. The components of the stars are the groups.

Numbers of links are exact, so a block of n different near copies costs comparisons of n * n / 2 pairs, in
tasks of two tiles; nothing but the tiles' counts leaves a task.

Results are one row per document. Defined results: null text, and text without a word, has no grams and no
links, and is its own group; equal ids are told apart by row, and equal rows are copies of each other; of a
group the row of the least id (or first number) is the first; other columns are ignored; an empty table gives
no rows. A very long text is one set in one row, and a tile of its own; grams are 64-bit hashes, and sets of
equal 128-bit names are equal sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, free, hashed, mixed, pieces_of, prepare, unused, with_key, words_of
from .components import components, small_stars

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 192
#: Classes in a tile, and the grams that each of them counts for at least; a task compares two tiles at a time.
TILE, ROW_GRAMS = 512, 4096


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest chance candidates, that reach the recall at the threshold within so many hashes."""
    for rows in range(most_hashes, 0, -1):
        bands = most_hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return most_hashes, 1


def grams(text: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text, the ascending distinct hashes of its word n-grams."""
    out: list[np.ndarray] = []
    for low, high in pieces_of(text):
        data, at = bytes_of(text.slice(low, high - low))
        starts, ends, first = words_of(data, at)
        word = hashed(data, starts, ends)
        n = np.diff(first)
        gram = np.zeros(len(word), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                # Words after a text's last one count as zero, which only texts of fewer words reach.
                gram *= np.uint64(0x9E3779B97F4A7C15)
                gram[: max(len(word) - k, 0)] += word[k:]
        short = np.flatnonzero((n > 0) & (n < words))
        for i in short.tolist():
            value = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(words):
                    value = value * np.uint64(0x9E3779B97F4A7C15) + (word[first[i] + k] if k < n[i] else np.uint64(0))
            gram[first[i]] = value
        gram = mixed(gram)
        counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        out += [np.unique(gram[a : a + c]) for a, c in zip(first[:-1].tolist(), counts.tolist(), strict=True)]
    return out


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240817)
        self.bands, self.rows = bands, rows
        self.factor = (rng.integers(0, 1 << 31, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
        self.shift = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)[:, None]

    def band_hashes(self, gram: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band of a non-empty set."""
        x = (gram >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for low in range(0, len(x), 1024):
                np.minimum(least, (self.factor * x[low : low + 1024] + self.shift).min(1), out=least)
            out = np.zeros(self.bands, np.uint64)
            for k in range(self.rows):
                out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + least[k :: self.rows].astype(np.uint64) + np.uint64(1))
            return mixed(out + np.arange(self.bands, dtype=np.uint64))


def _packed(rows: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind))


def _signatures(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Of rows (_row, text): _row, _a and _b (a 128-bit name of the gram set) and _bands (a hash for each band); null without grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            names, hashes = [], []
            for g in grams(batch.column(1).fill_null(""), words):
                with np.errstate(over="ignore"):
                    names.append((int(g.sum().view(np.int64)), int(np.bitwise_xor.reduce(mixed(g + np.uint64(1))).view(np.int64))) if len(g) else (None, None))
                hashes.append(signer.band_hashes(g) if len(g) else np.zeros(0, np.uint64))
            columns = [batch.column(0), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), _packed(hashes)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_a", "_b", "_bands"])

    return texts.mapInArrow(run, "_row bigint, _a bigint, _b bigint, _bands array<bigint>")


def _matched(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of two lists of distinct ascending sets reach the Jaccard threshold, exactly: counts of shared grams by a product of matrices."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    keep = many[column] > 1  # a gram of one set is in no pair
    rank = np.cumsum(many > 1) - 1
    column, owner = rank[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        shared += m[: len(left)] @ m[len(left) :].T
    sizes_l, sizes_r = np.array([len(x) for x in left])[:, None], np.array([len(x) for x in right])[None]
    return shared >= threshold * (sizes_l + sizes_r - shared) - 1e-6


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The components of the links between two lists of nodes, as stars: every other node with the least one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for i in np.flatnonzero(hit.any(1)).tolist():
        for j in np.flatnonzero(hit[i]).tolist():
            a, b = find(int(left[i])), find(int(right[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root)]


def link(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """For documents (doc_id, text): row numbers and groups.

    Returns _row, doc_id, copy_of (row of the first copy of an equal gram set), group_row (first row of the
    group), n_links (other documents at the threshold or more, copies included)."""
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = choose_bands(threshold, recall, most_hashes)
    inner = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    numbered = with_key(inner).withColumnRenamed("_key", "_row")
    given = numbered.select("_row", "doc_id")
    signed = cut(_signatures(numbered.select("_row", "text"), words, bands, rows))
    sets = signed.select("_row", "_a", "_b")
    classes = sets.where(F.col("_a").isNotNull()).groupBy("_a", "_b").agg(F.min("_row").alias("copy_of"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes)
    firsts = classes.select(F.col("copy_of").alias("_row"), "copies")
    signed = signed.select("_row", "_bands").join(firsts, "_row", "left_semi")
    spread = signed.select("_row", F.posexplode("_bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.min("_row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = spread.join(buckets, ["band", "hash"]).where("_row != least").groupBy(F.col("_row").alias("a")).agg(F.collect_set("least").alias("smaller"))  # a node for each band at most
    found = components(small_stars(linked))
    free(spark)
    blocks = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    found_links, forest = _verify(numbered, firsts, cut(blocks), words, threshold)
    groups = components(forest)
    return (
        given.join(sets.join(classes.select("_a", "_b", "copy_of", "copies"), ["_a", "_b"], "left").select("_row", F.coalesce("copy_of", "_row").alias("copy_of"), F.coalesce("copies", F.lit(1)).alias("copies")), "_row")
        .join(found_links.select(F.col("_row").alias("copy_of"), "links"), "copy_of", "left")
        .join(groups.select(F.col("node").alias("copy_of"), "root"), "copy_of", "left")
        .select("_row", "doc_id", "copy_of", F.coalesce("root", "copy_of").alias("group_row"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )


def _verify(numbered: DataFrame, firsts: DataFrame, blocks: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact links within blocks (node, root): (_row, links), and stars (a, b) whose components are the groups."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = grams(batch.column(0).fill_null(""), words)
            yield pa.RecordBatch.from_arrays([_packed(sets), pa.array([len(x) for x in sets], pa.int32()), *batch.columns[1:]], names=["grams", "size", *batch.schema.names[1:]])

    members = numbered.select("_row", "text").join(blocks.select(F.col("node").alias("_row"), "root"), "_row").join(firsts, "_row")
    members = members.select("text", "_row", "root", "copies").mapInArrow(sized, "grams array<bigint>, size int, _row bigint, root bigint, copies bigint")
    members = cut(members)
    free(members.sparkSession)
    # Tiles of a block hold neighbours in size: places come from counts by (block, size), so that no block is sorted by one task.
    from pyspark.sql import Window

    salted = members.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(64)))
    counts = salted.groupBy("root", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("root").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.greatest(F.col("size"), F.lit(ROW_GRAMS)).cast("bigint")
    counts = counts.select("root", "size", "salt", F.coalesce(F.sum(F.col("n") * weight).over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("root", "size", "salt").orderBy("_row")
    tiled = salted.select("_row", "root", "size", "salt").withColumn("k", F.row_number().over(own) - 1).join(counts, ["root", "size", "salt"])
    tiled = cut(tiled.select("_row", "root", "size", F.floor((F.col("base") + F.col("k") * weight) / (TILE * ROW_GRAMS)).cast("int").alias("tile")))
    tiles = tiled.groupBy("root", "tile").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.lit(1)).alias("n"))
    left, right = tiles.select("root", F.col("tile").alias("i"), F.col("high").alias("high_i"), F.col("n").alias("n_i")), tiles.select("root", F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("n").alias("n_j"))
    meets = left.join(right, "root").where((F.col("i") < F.col("j")) & (F.col("high_i") >= threshold * F.col("low_j") - 1e-6) | (F.col("i") == F.col("j")) & (F.col("n_i") > 1))
    meets = meets.select("root", "i", "j")
    ends = meets.select("root", F.col("i").alias("tile"), "i", "j").union(meets.where("i != j").select("root", F.col("j").alias("tile"), "i", "j"))
    placed = members.join(tiled.select("_row", "tile"), "_row")
    dealt = placed.join(ends, ["root", "tile"])

    def compare(table: pa.Table) -> pa.Table:
        tile = table.column("tile").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        row, copies = table.column("_row").to_numpy(), table.column("copies").to_numpy()
        column = table.column("grams").combine_chunks()
        at, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
        sets = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        hit = _matched([sets[k] for k in a.tolist()], [sets[k] for k in b.tolist()], threshold)
        if i == j:
            np.fill_diagonal(hit, False)
        links = {int(r): int(n) for r, n in zip(row[a], hit @ copies[b], strict=True)}
        if i != j:
            for r, n in zip(row[b], copies[a] @ hit, strict=True):
                links[int(r)] = links.get(int(r), 0) + int(n)
        out = [(r, None, n) for r, n in links.items() if n] + [(x, y, 0) for x, y in _forest(hit, row[a], row[b])]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "links": pa.array([x[2] for x in out], pa.int64())})

    # Blocks of one tile go many to a task; the grouping key alone decides what meets.
    result = cut(dealt.groupBy("root", "i", "j").applyInArrow(compare, "a bigint, b bigint, links bigint"))
    links = result.where(F.col("b").isNull()).groupBy(F.col("a").alias("_row")).agg(F.sum("links").alias("links"))
    return links, result.where(F.col("b").isNotNull()).select("a", "b")


def groups(docs: DataFrame, **options: float) -> DataFrame:
    """One row per document: doc_id, class_id (the first document of its group), n_links."""
    found = link(docs, **options)
    names = found.select(F.col("_row").alias("group_row"), F.col("doc_id").alias("class_id"))
    return found.join(names, "group_row").select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame, **options: float) -> DataFrame:
    """All columns of the documents that stand first in their group."""
    key = unused(docs, "_key")
    keyed = with_key(docs, key)
    found = groups(keyed.select(F.col(key).alias("doc_id"), "text"), **options).where("doc_id = class_id")
    return keyed.join(found.select(F.col("doc_id").alias(key)), key, "left_semi").select(*docs.columns)
