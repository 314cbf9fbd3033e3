"""Text queries against their DuckDB SQL, and the columns that the others return."""

import pytest

from peptrail.llm import queries
from tests.compare import duck, rows

COLUMNS = {
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    cursor = duck(sf_dir).execute(queries.oracle_sql()[name])
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
