"""Golden values, properties and edge rows of descriptors and candidates."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peptrail.functions import numeric, sequence
from peptrail.functions.residues import ALPHABET, KYTE_DOOLITTLE
from peptrail.sources import candidates

#: sequence, hydrophobicity, Hopp-Woods index, charge, isoelectric step, tenths, motif score
GOLDEN = [
    ("G", 0.4, 0.0, -0.009891, 400, 0, 0),
    ("K", 3.9, -3.0, 0.989793, 974, 10, 0),
    ("DDDD", 3.5, -3.0, -4.006716, 260, -40, 0),
    ("EEEEKKKK", 3.7, -3.0, -0.006126, 656, 0, 0),
    ("VRVVRVRVRVVRVR", -0.471429, -0.428571, 5.99009, 1320, 60, 22),
    ("LRLLRLRLRLLRLR", -0.242857, -0.257143, 5.99009, 1320, 60, 11),
    ("WRWWRWRWRWWRWR", 2.442857, 0.657143, 5.99009, 1320, 60, 0),
    ("KKKKKKKKKKKKKK", 3.9, -3.0, 13.985683, None, 140, 0),
    ("RRRRRCCCCCCCCCC", -0.166667, -0.333333, 4.512826, None, 50, 0),
]


def test_golden(spark):
    s = F.col("seq")
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "seq string")
    got = df.select("seq", F.round(sequence.hydrophobicity(s), 6), F.round(sequence.amphipathic_index(s, "Hopp-Woods"), 6), F.round(sequence.charge(s), 6), sequence.isoelectric_index(s), sequence.table_charge_tenths(s), sequence.motif_score(s))
    assert {tuple(r) for r in got.collect()} == set(GOLDEN)


def test_empty_unknown_and_null(spark):
    df = spark.createDataFrame([("",), (None,), ("X",)], "seq string")
    s = F.col("seq")
    got = df.select(sequence.hydrophobicity(s), sequence.motif_score(s), sequence.table_charge_tenths(s)).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0), (None, None, None), (0.0, 0, 0)]
    with pytest.raises(Exception, match="unknown residue"):
        df.select(sequence.hydrophobicity(s, strict=True)).collect()
    with pytest.raises(ValueError):
        sequence.amphipathic_index(s, "other")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(ALPHABET, min_size=1, max_size=30), min_size=1, max_size=20))
def test_properties(spark, words):
    s = F.col("seq")
    df = spark.createDataFrame([(w,) for w in words], "seq string")
    for r in df.select("seq", sequence.hydrophobicity(s), sequence.penetration_depth(s), sequence.charge(s, 3.0), sequence.charge(s, 9.0), sequence.isoelectric_index(s)).collect():
        mean = sum(KYTE_DOOLITTLE[c] for c in r[0]) / len(r[0])
        assert abs(r[1] + mean) < 1e-9 and abs(r[2] - mean) < 1e-9 and r[3] > r[4]


@pytest.mark.parametrize(("w", "emitted", "distinct", "first"), [(2, 0, 0, []), (3, 13, 8, ["VRRVRR", "VRRVRR", "LRRLRR"]), (4, 220, 201, ["GVRRGVRR", "GKVRGKVR", "GKRVGKRV"]), (5, 6100, 5262, ["GGVRRGGVRR", "GGKVRGGKVR", "GGKRVGGKRV"])])
def test_candidates(spark, w, emitted, distinct, first):
    found = candidates.candidates(spark, w).orderBy("num", "branch").collect()
    assert len(found) == emitted and len({r.seq for r in found}) == distinct and [r.seq for r in found[:3]] == first
    assert candidates.candidates(spark, w, distinct=True).count() == distinct


def test_both_ways_of_enumeration(spark):
    words = candidates.words(spark, 3, 1, 8000)
    slow = candidates.emit(words.select("num", "word", candidates.passes(F.col("word")).alias("ok")))
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, candidates.candidates(spark, 3).collect()))


def test_missing_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(None,), (nan,), (4.0,), (4.0001,), (1.0,), (2.0,), (3.99,), (8.0,), (inf,)], "m double")
    m = F.col("m")
    got = df.select(numeric.activity_label(m), numeric.mic_level(m), numeric.filled(m), numeric.cleaned(m)).collect()
    assert [r[0] for r in got] == [1, 1, 1, 0, 1, 1, 1, 0, 0]
    assert [r[1] for r in got][:8] == [None, None, 2, 2, 0, 1, 1, 3]
    assert [r[2] for r in got][:2] == [0.0, 0.0] and got[8][3] == 0.0


def test_pair_feature_guard(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0], [-1e-6, -1e-6, -1e-6, 1.0])], "a array<double>, b array<double>")
    f = df.select(numeric.pair_features(F.col("a"), F.col("b"))).first()[0]
    assert f[12] == float("inf") and f[13] == float("-inf") and f[14] != f[14] and abs(f[15] - 2 / 1.000001) < 1e-12


def test_sql_functions(spark):
    sequence.register(spark)
    assert round(spark.sql("SELECT hydrophobicity('G')").first()[0], 6) == 0.4
    assert round(spark.sql("SELECT net_charge('K')").first()[0], 6) == 0.989793
