"""Descriptors of residue sequences as Column expressions; all stay in generated code.

Every descriptor depends on counts of residues, so it is a sum of counts times constants. Empty sequences
give null where a mean is asked for. Unknown residues are ignored by charges; the hydropathy means raise an
error on them if `strict`, and otherwise count them as zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .residues import ACID, ALPHABET, BASE, C_TERMINAL, HOPP_WOODS, KYTE_DOOLITTLE, MOTIFS, N_TERMINAL, TABLE_CHARGE


def residue_count(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _mean(seq: Column, table: dict[str, float], strict: bool) -> Column:
    total = _sum([residue_count(seq, r) * F.lit(v) for r, v in table.items()])
    mean = total / F.nullif(F.length(seq), F.lit(0))
    if strict:
        mean = F.when(seq.rlike(f"[^{ALPHABET}]"), F.raise_error(F.concat(F.lit("unknown residue in "), seq)).cast("double")).otherwise(mean)
    return mean


def hydrophobicity(seq: Column, strict: bool = False) -> Column:
    return F.lit(0.0) - _mean(seq, KYTE_DOOLITTLE, strict)


def penetration_depth(seq: Column, strict: bool = False) -> Column:
    return _mean(seq, KYTE_DOOLITTLE, strict)


def amphipathic_index(seq: Column, index_type: str = "Kyte-Doolittle", strict: bool = False) -> Column:
    tables = {"Kyte-Doolittle": KYTE_DOOLITTLE, "Hopp-Woods": HOPP_WOODS}
    if index_type not in tables:
        raise ValueError(f"index_type must be one of {', '.join(tables)}")
    return F.lit(0.0) - _mean(seq, tables[index_type], strict)


def _part(x: Column) -> Column:
    """Henderson-Hasselbalch: charged share at a distance of x from the pKa."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), x))


def charge_of_counts(count: Callable[[str], Column], ph: Column) -> Column:
    terms = [_part(ph - N_TERMINAL), F.lit(0.0) - _part(F.lit(C_TERMINAL) - ph)]
    terms += [F.lit(0.0) - count(r) * _part(F.lit(k) - ph) for r, k in ACID.items()]
    terms += [count(r) * _part(ph - k) for r, k in BASE.items()]
    return _sum(terms)


def charge(seq: Column, ph: float = 7.0) -> Column:
    """Net charge at a pH."""
    return charge_of_counts(lambda r: residue_count(seq, r), F.lit(float(ph)))


def table_charge_tenths(seq: Column) -> Column:
    """Table charge in whole tenths, so that bounds are compared exactly."""
    return _sum([residue_count(seq, r) * v for r, v in TABLE_CHARGE.items()])


def motif_score(seq: Column) -> Column:
    """Weighted number of four-residue motifs, overlaps counted: zero-width matches look at every place."""
    return _sum([F.lit(w) * F.regexp_count(seq, F.lit("(?=" + "|".join(m) + ")")) for w, m in MOTIFS.items()])


def isoelectric_index(seq: Column, steps: int = 1400, per_unit: int = 100, tolerance: float = 0.01) -> Column:
    """First grid step k of pH k / per_unit at which the absolute charge is under the tolerance; null if none is.

    The charge falls with pH, so only the first step with a charge under the tolerance can qualify; it is
    found by bisection over the grid, whose state is one number."""
    bits = steps.bit_length()
    counts = F.struct(*(residue_count(seq, r).cast("double").alias(r) for r in [*ACID, *BASE]))

    def at(c: Column, k: Column) -> Column:
        return charge_of_counts(lambda r: c[r], k / F.lit(float(per_unit)))

    def halve(c: Column, low: Column, step: Column) -> Column:
        # low: steps known to be too low in pH. Move up while the charge there is still at the tolerance or more.
        return F.when((low + step <= steps + 1) & (at(c, (low + step - 1).cast("double")) >= tolerance), low + step).otherwise(low)

    def search(c: Column) -> Column:
        jumps = F.array(*(F.lit(1 << b) for b in reversed(range(bits + 1))))
        first = F.aggregate(jumps, F.lit(0), lambda low, step: halve(c, low, step))
        # Through an array of one, as every mention of the bisection would run it again.
        return F.element_at(F.transform(F.array(first), lambda k: F.when((k <= steps) & (at(c, k.cast("double")) > -tolerance), k)), 1)

    return F.element_at(F.transform(F.array(counts), search), 1)


def isoelectric_point(seq: Column, precision: float = 0.01) -> Column:
    per_unit = round(1 / precision)
    return isoelectric_index(seq, 14 * per_unit, per_unit, precision) / F.lit(float(per_unit))


def spaced(seq: Column) -> Column:
    """Residues parted by spaces, as tokenizers of protein models want them."""
    return F.array_join(F.split(seq, ""), " ")


def mirrored(word: Column) -> Column:
    return F.concat(word, F.reverse(word))


def doubled(word: Column) -> Column:
    return F.concat(word, word)


#: Descriptor columns that can be computed from a sequence.
REGISTRY: dict[str, Callable[[Column], Column]] = {
    "hydrophobicity": hydrophobicity,
    "charge": charge,
    "isoelectric_point": isoelectric_point,
    "penetration_depth": penetration_depth,
    "amphipathic_index": amphipathic_index,
}

#: Descriptor columns that only an input table can have.
INPUT_ONLY = ("tilt_angle", "disorder_tendency", "linear_moment", "aggregation_tendency", "hydrophobic_angle", "ppii_tendency")


def register(spark) -> None:
    """Make the closed-form descriptors SQL functions of one string argument (SQL bodies, which the optimizer inlines)."""

    def count(r: str) -> str:
        return f"(length(seq) - length(replace(seq, '{r}', '')))"

    def mean(table: dict[str, float]) -> str:
        return "(" + " + ".join(f"{count(r)} * {v}D" for r, v in table.items()) + ") / nullif(length(seq), 0)"

    def net_charge(ph: str, count: Callable[[str], str] = count) -> str:
        acid = "".join(f" - {count(r)} / (1 + pow(10D, {k}D - {ph}))" for r, k in ACID.items())
        base = "".join(f" + {count(r)} / (1 + pow(10D, {ph} - {k}D))" for r, k in BASE.items())
        return f"1 / (1 + pow(10D, {ph} - {N_TERMINAL}D)) - 1 / (1 + pow(10D, {C_TERMINAL}D - {ph})){acid}{base}"

    # As in isoelectric_index: counts once, then bisection over the grid of 1,401 steps.
    counts = ", ".join(f"'{r}', {count(r)}" for r in [*ACID, *BASE])
    at = lambda step: net_charge(f"(({step}) / 100D)", lambda r: f"c.{r}")
    jumps = ", ".join(str(1 << b) for b in reversed(range(12)))
    first = f"aggregate(array({jumps}), 0, (low, step) -> IF(low + step <= 1401 AND {at('low + step - 1')} >= 0.01D, low + step, low))"
    search = f"element_at(transform(array({first}), k -> IF(k <= 1400 AND {at('k')} > -0.01D, k / 100D, NULL)), 1)"
    bodies = {
        "hydrophobicity": f"0D - {mean(KYTE_DOOLITTLE)}",
        "penetration_depth": mean(KYTE_DOOLITTLE),
        "amphipathic_index": f"0D - {mean(KYTE_DOOLITTLE)}",
        "net_charge": net_charge("7D"),
        "isoelectric_point": f"element_at(transform(array(named_struct({counts})), c -> {search}), 1)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(seq STRING) RETURNS DOUBLE RETURN {body}")
