"""Small document frames with the odd cases that every operator must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls in every column, empty and blank texts, equal rows, equal ids with other texts.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the old stone bridge at noon", "en", "s", 70),
    (2, "", "en", None, 0),
    (3, None, "en", "s", None),
    (4, " \n\t ", None, "s", 4),
    (None, "le renard brun saute par dessus le chien paresseux près du vieux pont", "fr", "s", 60),
    (5, "the quick brown fox jumps over the lazy dog near the old stone bridge at noon", "en", "s", 70),
    (5, "the quick brown fox jumps over the lazy dog near the old stone bridge at noon", "en", "s", 70),
    (6, "mail a.b@c-d.org or +1 (743) 555-3824 from 10.0.0.1, card 4539 1488 0343 6467.", "en", "s", 80),
    (7, "word " * 3000, "en", "s", 15000),
    (8, "éß\U0001f600" * 40, None, None, 120),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    for name in ("_row", "_key", "piece", "start", "length", "score", "lang_pred", "unit", "hash", "spans", "kept", "_t", "_0"):
        df = df.withColumn(name, F.lit("x"))
    return df


def thue_morse(*steps):
    """For each number of steps, the word of 2 ** steps letters and its complement."""
    out = []
    for n in steps:
        word = [k.bit_count() % 2 for k in range(1 << n)]
        out += ["".join("ab"[x] for x in word), "".join("ba"[x] for x in word)]
    return out
