"""Feature frames: scalar descriptors, embeddings and structure tables, joined by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cleaned, cleaned_vector, filled
from ..functions.sequence import INPUT_ONLY, REGISTRY

#: What a caller may ask for: all named columns of the input, those that could be computed, or computed ones.
MODES = ("all", "calculable", "calculated", "none")


def descriptors(df: DataFrame, mode: str = "calculated", seq: str = "seq") -> DataFrame:
    """Add or choose descriptor columns; an unknown mode is an error, never an empty choice."""
    keys = [c for c in df.columns if c not in (*REGISTRY, *INPUT_ONLY)]
    if mode == "all":
        return df.select(*keys, *REGISTRY, *INPUT_ONLY)
    if mode == "calculable":
        return df.select(*keys, *(c for c in REGISTRY if c in df.columns))
    if mode == "calculated":
        return df.select(*keys, *(build(F.col(seq)).alias(c) for c, build in REGISTRY.items()))
    if mode == "none":
        return df.select(*keys)
    raise ValueError(f"mode must be one of {', '.join(MODES)}")


def structure_lookup(df: DataFrame, structure: DataFrame, columns: list[str], order: str = "row_id", all_duplicates: bool = False) -> DataFrame:
    """Left lookup by seq with 0.0 for what is not there. Only the last row of a repeated sequence receives values, unless all are to."""
    marked = df
    if not all_duplicates:
        # The last row of a sequence by aggregation, which combines repeats before the shuffle.
        last = df.groupBy("seq").agg(F.max(order).alias("_last"))
        right = last.join(structure.select("seq", *columns), "seq").select("seq", F.col("_last").alias(order), *(F.col(c).alias(f"_{c}") for c in columns))
        joined = marked.join(right, ["seq", order], "left")
    else:
        joined = marked.join(structure.select("seq", *(F.col(c).alias(f"_{c}") for c in columns)), "seq", "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(f"_{c}").cast("double"), F.lit(0.0)).alias(c) for c in columns))


def cache_hits(df: DataFrame, cache: DataFrame, key: str = "seq") -> DataFrame:
    """Distinct keys that the cache has."""
    return df.select(key).distinct().join(cache.select(key), key, "left_semi")


def cache_misses(df: DataFrame, cache: DataFrame, key: str = "seq") -> DataFrame:
    """Distinct keys that the cache lacks."""
    return df.select(key).distinct().join(cache.select(key), key, "left_anti")


def feature_matrix(df: DataFrame, embeddings: DataFrame, scalars: list[str], key: str = "row_id") -> DataFrame:
    """key, scalars and embedding as one array of doubles, missing numbers as 0; rows without an embedding are left out."""
    vector = F.concat(F.array(*(filled(F.col(c).cast("double")) for c in scalars)), F.col("embedding").cast("array<double>"))
    return df.join(embeddings.select(key, "embedding"), key).select(key, vector.alias("features"))


def unmatched(df: DataFrame, embeddings: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that a feature matrix would leave out; empty when blocks line up."""
    return df.join(embeddings.select(key), key, "left_anti")


def long_form(matrix: DataFrame, key: str = "row_id") -> DataFrame:
    """key, place, value of a matrix."""
    return matrix.select(key, F.posexplode("features").alias("place", "value"))


def clean(df: DataFrame, scalars: list[str], vectors: list[str] = ()) -> DataFrame:
    """Missing and infinite numbers become 0."""
    return df.withColumns({**{c: cleaned(F.col(c)) for c in scalars}, **{c: cleaned_vector(F.col(c)) for c in vectors}})


def mean_pooled(tokens: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The element-wise mean of the vectors of each key; partial means are combined before the shuffle."""
    each = tokens.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(vector))


def rows_of(df: DataFrame, wanted: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows by a list of keys, repeated as often as the list repeats them."""
    return wanted.join(df, key)


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are missing there."""
    return df.unionByName(more, allowMissingColumns=True)


def positives(df: DataFrame, prediction: str = "prediction", key: str = "seq_id") -> DataFrame:
    """Rows predicted 1, numbered anew from 0 in the order of their key."""
    from .indexing import dense_index

    return dense_index(df.where(F.col(prediction) == 1), key, "i")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of equal keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
