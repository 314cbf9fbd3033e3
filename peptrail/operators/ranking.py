"""Stable ranking and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, n: int = 1000, score: str = "score", key: str = "i") -> DataFrame:
    """The n highest scores with their rank; equal scores keep the order of their key. Each task keeps n rows at most."""
    best = df.orderBy(F.desc(score), F.asc(key)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def ordered_by_value(df: DataFrame, value: str = "mic", key: str = "i") -> DataFrame:
    """Ascending values, missing ones last, equal ones by key."""
    return df.orderBy(F.asc_nulls_last(value), F.asc(key))


def first_rows(df: DataFrame, n: int | None, key: str = "seq_id") -> DataFrame:
    """The first n rows by key; all for None."""
    return df if n is None else df.orderBy(key).limit(n)
