"""Labels, levels and vector arithmetic, with missing values (null or NaN) told apart from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def known(x: Column) -> Column:
    """The number, or null where it is NaN."""
    return F.when(~F.isnan(x), x)


def activity_label(mic: Column, cut: float = 4.0) -> Column:
    """0 above the cut, else 1; a missing value is not above it."""
    return F.when(F.coalesce(known(mic) > cut, F.lit(False)), 0).otherwise(1)


def mic_level(mic: Column) -> Column:
    """Whole powers of two in a value over 1, else 0; null for a missing or infinite value."""
    x = known(mic)
    return F.when(x > 1, F.log2(F.greatest(x, F.lit(1.0))).try_cast("int")).when(x.isNotNull(), 0)


def rank_label(a: Column, b: Column) -> Column:
    """0 for equal, 1 for a below b, 2 for a above b."""
    return F.when(a == b, 0).when(a < b, 1).otherwise(2)


def filled(x: Column) -> Column:
    """0 where missing."""
    return F.coalesce(known(x), F.lit(0.0))


def cleaned(x: Column) -> Column:
    """0 where missing or infinite."""
    return F.when(F.abs(x) == F.lit(float("inf")), 0.0).otherwise(filled(x))


def cleaned_vector(v: Column) -> Column:
    return F.transform(v, cleaned)


def pair_features(a: Column, b: Column) -> Column:
    """Both vectors, their difference, and the first over the second plus a small number.

    A denominator of exactly zero gives a signed infinity, or NaN for zero over zero, without raising."""

    def over(x: Column, y: Column) -> Column:
        d = y + F.lit(EPSILON)
        inf = F.lit(float("inf"))
        return F.when(d != 0, F.try_divide(x, d)).when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan")))

    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, over))


def sample_weight(log_target: Column, rare: float = 0.01, weight: float = 10.0) -> Column:
    """A weight for rows of one special target value, else 1."""
    return F.when(log_target == F.log2(F.lit(rare)), weight).otherwise(1.0)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def two_places(x: Column) -> Column:
    """Text with two decimal places."""
    return F.format_string("%.2f", x)


def thousands(n: Column) -> Column:
    """Text of a whole number with separators."""
    return F.format_number(n, 0)
