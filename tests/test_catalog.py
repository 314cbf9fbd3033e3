"""Every registered query of the screening operators against its SQL, on the smallest tables."""

import pytest

from peptrail import catalog
from tests.compare import duck, rows

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    cursor = duck(sf_dir).execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert got == rows(names, cursor.fetchall())


def test_search_queries(spark, sf_dir):
    """What their rows must be, whatever trees find."""
    table = QUERIES["regressor_search"](spark, sf_dir).collect()
    assert len(table) == 32 and sorted(r.place for r in table) == list(range(1, 33)) and len({r.point for r in table}) == 32
    assert [r.wrmse for r in sorted(table, key=lambda r: r.place)] == sorted(r.wrmse for r in table)
    assert all(abs(r.wrmse**2 - r.wmse) < 0.2 * r.wmse and r.wmae <= r.wrmse and r.most_used <= r.rounds for r in table)
    rounds = {r.fold: r for r in QUERIES["comparator_rounds"](spark, sf_dir).collect()}
    assert set(rounds) == {0, 1, 2, None} and all(1 <= r.best_round <= r.rounds <= 40 and r.best_loss <= r.last_loss for r in rounds.values())


def test_screening_query(spark, sf_dir):
    """The best of the positives, in the order of their scores; plain values are powers of the logarithms."""
    found = QUERIES["screening_pipeline"](spark, sf_dir).collect()
    ranked = sorted(found, key=lambda r: r.rank)
    assert found and [r["rank"] for r in ranked] == list(range(1, len(found) + 1))
    assert [(-r.score, r.i) for r in ranked] == sorted((-r.score, r.i) for r in found)
    assert sum(r.score for r in found) == 0 or len(found) == 1000
    assert all(abs(r.mic - 2**r.log2_mic) < 1e-4 * max(1.0, r.mic) for r in found)


def test_tiers_query(spark, sf_dir):
    found = {(r.tier, r.metric): r.value for r in QUERIES["training_tiers"](spark, sf_dir).collect()}
    weighted = {"accuracy", "precision", "recall", "f1"}
    assert {m for t, m in found if t == "classifier"} == {m for t, m in found if t == "comparator"} == weighted
    assert {m for t, m in found if t == "regressor"} == {f"{p}{m}" for p in ("", "plain_") for m in ("r2", "mae", "mse", "rmse")}
    assert all(0 <= v <= 1 for (t, m), v in found.items() if m in weighted) and all(found[t, "accuracy"] == found[t, "recall"] for t in ("classifier", "comparator"))
    assert abs(found["regressor", "rmse"] ** 2 - found["regressor", "mse"]) < 1e-4


def test_every_query_is_checked():
    """A query without SQL is checked by name here or among the models."""
    models = {"classifier_fit_predict", "comparator_fit_predict", "regressor_fit_predict", "importance_top10"}
    assert set(QUERIES) - set(ORACLE) == models | {"regressor_search", "comparator_rounds", "screening_pipeline", "training_tiers"}
