"""I-Match document fingerprints, in DataFrame expressions.

Terms are lower-cased words without ASCII marks. Terms whose document frequency lies in a band (by share of
all documents) make the lexicon; its size is at most the mean number of distinct terms in a document over
the band's lower bound, for any size of corpus. `SUBSETS` randomised lexicons keep a half, a quarter, an
eighth and so on of its terms, by digits of a hash, so that texts of any length have a subset in which they
hold only a few terms: there, near copies mostly hold the same ones. A fingerprint has, for each subset, the
hash of a document's sorted distinct terms in it; the likeness of two fingerprints is the share of equal
parts. Fewer than `LEAST_TERMS` terms would agree by chance, and do not make a part.

Defined results: null text is empty text; a part without enough terms is the hash of the whole text, so that
only equal texts agree in it; equal ids are ordered by text; a null id sorts below all others; repeated rows
get a row each; other columns are ignored; an empty table gives no rows. Very long texts are taken whole: a
row for each distinct term is shuffled, not the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, prepare, text_or_empty

#: The band of document frequency, as shares of all documents, and a floor in documents.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.001, 0.2, 2
#: Randomised lexicons; terms that a part needs.
SUBSETS, LEAST_TERMS = 8, 3
#: Terms of a lexicon that is broadcast, some 50 MB; a larger one meets the texts' terms by a shuffle.
MOST_BROADCAST = 500_000
#: Keys that rows of facts are dealt to, so that they make no hot key of that join.
FACT_KEYS = 256

#: Fixed value: ASCII marks.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    words = F.split(F.translate(F.lower(text), MARKS, ""), "[ \\t-\\r]+")
    return F.filter(F.array_distinct(words), lambda w: w != "")


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """term, subsets (a bit for each lexicon that has it) of every term that a lexicon has and whose document frequency lies in the band, over all rows (text)."""
    n = texts.agg(F.count(F.lit(1))).first()[0]
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One condition that needs the frequency: it cannot move below the aggregation, where each row's term would be hashed.
    band = (F.col("df") >= max(LEAST_DOCS, least * n)) & (F.col("df") <= max(LEAST_DOCS, most * n))
    return counted.select("term", F.when(band, _subsets(F.col("term"))).alias("subsets")).where("subsets > 0")


def kept_below(k: int) -> str:
    """Four hexadecimal digits under this keep a term in the k-th lexicon: half of all terms for the first, then half as many each time."""
    return f"{(1 << 16) >> (k + 1):04x}"


def _subsets(term: Column) -> Column:
    """Bits of the randomised lexicons that keep a term: its hash gives each of them four digits."""
    digits = F.md5(term.cast("binary"))
    return reduce(lambda bits, k: bits + F.when(F.substring(digits, 4 * k + 1, 4) < kept_below(k), 1 << k).otherwise(0), range(SUBSETS), F.lit(0))


def _parts(kept: Column, whole: Column) -> Column:
    """The fingerprint of a text, whose hash is given, from its terms in the lexicon: structs (term, subsets), sorted."""

    def part(k: int) -> Column:
        chosen = F.transform(F.filter(kept, lambda t: t["subsets"].bitwiseAND(F.lit(1 << k)) > 0), lambda t: t["term"])
        return F.substring(F.sha1(F.when(F.size(chosen) >= LEAST_TERMS, F.concat(F.lit("t"), F.array_join(chosen, " "))).otherwise(F.concat(F.lit("w"), whole)).cast("binary")), 1, 16)

    return F.concat_ws("-", *(part(k) for k in range(SUBSETS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts of two fingerprints."""
    x, y = F.split(a, "-"), F.split(b, "-")
    same = reduce(lambda s, k: s + F.when(F.get(x, F.lit(k)) == F.get(y, F.lit(k)), 1).otherwise(0), range(SUBSETS), F.lit(0))
    return same / F.lit(float(SUBSETS))


def _next_ids(docs: DataFrame) -> DataFrame:
    """_key, next (the _key of the next row in descending order of _key; of the largest for the least), for rows with distinct whole _key.

    Ids are dealt into ranges, so that none is sorted in one task; only a row for each range meets the others."""
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ids = cut(docs.select("_key").repartitionByRange(ranges, "_key").withColumn("_range", F.spark_partition_id()))
    ends = ids.groupBy("_range").agg(F.max("_key").alias("top"))
    before = Window.orderBy("_range")
    largest = ends.agg(F.max("top")).first()[0]
    ends = ends.select("_range", F.lag("top").over(before).alias("_before"))
    own = Window.partitionBy("_range").orderBy("_key")
    return ids.withColumn("_lag", F.lag("_key").over(own)).join(ends, "_range").select("_key", F.coalesce(F.col("_lag"), F.col("_before"), F.lit(largest).cast("bigint")).alias("next"))


def compare(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edited texts.

    The edited text has the last half of the text's code points replaced by the first as many (or all) of the
    next document's, in descending order of doc_id; after the last comes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    prepare(docs.sparkSession)
    texts = keyed_in_order(docs)
    words = cut(lexicon(texts, least, most))
    sizes = texts.select("_key", "doc_id", F.length("text").alias("n"))
    following = cut(_next_ids(texts.select("_key")).join(sizes, "_key").select("_key", "doc_id", "next", F.floor(F.col("n") / 2).cast("int").alias("half")))
    free(docs.sparkSession)
    # Both joins take the same two columns of the texts, which are therefore shuffled once.
    texts = texts.select("_key", "text")
    # Each document sends the start of its text to the one before it, as much as that one needs.
    sends = texts.join(following.select(F.col("next").alias("_key"), F.col("_key").alias("to"), "half"), "_key")
    sends = sends.select(F.col("to").alias("_key"), F.substring("text", F.lit(1), F.col("half")).alias("start"))
    both = texts.join(sends, "_key")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 2).cast("int")), F.col("start"))
    both = both.select("_key", "text", edited.alias("edited"))
    # One generator gives a row of facts, under a name that no term has, and a row for each term of either text; the
    # text itself goes no further. Rows meet the lexicon, and come together again by the key that they are
    # partitioned on: a lexicon of checked size is broadcast, and rows meet it where they are.
    text, edit = F.col("text"), F.col("edited")
    facts = F.struct(F.length(text).cast("bigint").alias("n_chars"), F.sha2(edit.cast("binary"), 256).alias("edited_sha256"), F.sha1(text.cast("binary")).alias("whole"), F.sha1(edit.cast("binary")).alias("edited_whole"))

    def row(of: int, term: Column) -> Column:
        return F.struct(F.lit(of).alias("of"), term.alias("term"), F.when(F.lit(of == 0), facts).alias("facts"))

    named = F.concat(F.lit("!"), F.pmod(F.xxhash64("_key"), F.lit(FACT_KEYS)).cast("string"))
    rows = F.concat(F.array(row(0, named)), F.transform(terms(text), lambda t: row(1, t)), F.transform(terms(edit), lambda t: row(2, t)))
    each = both.select("_key", F.explode(rows).alias("r")).select("_key", "r.*")
    known = words.union(words.sparkSession.range(FACT_KEYS).select(F.concat(F.lit("!"), F.col("id").cast("string")).alias("term"), F.lit(0).alias("subsets")))
    met = each.join(F.broadcast(known) if words.count() <= most_broadcast else known.hint("merge"), "term")
    gathered = [F.sort_array(F.collect_list(F.when(F.col("of") == of, F.struct("term", "subsets")))).alias(name) for of, name in ((1, "own"), (2, "new"))]
    grouped = met.groupBy("_key").agg(F.first("facts", ignorenulls=True).alias("f"), *gathered)
    marked = cut(grouped.select("_key", "f.n_chars", "f.edited_sha256", _parts(F.col("own"), F.col("f.whole")).alias("fingerprint"), _parts(F.col("new"), F.col("f.edited_whole")).alias("edited_fingerprint")))
    nexts = following.select("_key", "doc_id", "next").join(marked.select(F.col("_key").alias("next"), F.col("fingerprint").alias("_next_fingerprint")), "next")
    out = marked.join(nexts.select("_key", "doc_id", "_next_fingerprint"), "_key")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_fingerprint")).alias("near_next"))


def keyed_in_order(docs: DataFrame) -> DataFrame:
    """_key (whole, distinct, in order of doc_id, then text), doc_id, text of documents."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") and not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return texts.withColumn("_key", F.col("doc_id").cast("bigint"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = texts.repartitionByRange(ranges, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return cut(ordered.withColumn("_key", F.monotonically_increasing_id()))
