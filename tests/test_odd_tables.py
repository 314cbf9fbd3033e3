"""Registered queries against their SQL on tables that the given ones do not show: odd texts, more pairs than the cap, long groups."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peptrail import catalog
from peptrail.functions.residues import ALPHABET
from peptrail.operators import indexing
from peptrail.sources import candidates
from tests.compare import duck

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def same(spark, folder, name):
    """Rows of the query and of its SQL, null and empty told apart."""
    found = QUERIES[name](spark, folder)
    cursor = duck(folder).execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    got = sorted(repr(tuple(r[c] for c in names)) for r in found.collect())
    assert got == sorted(repr(tuple(r)) for r in cursor.fetchall())
    return got


def write(folder, **tables):
    import pyarrow.parquet as pq

    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


ODD = ["", " ", " en", "en ", "a,b", 'q"q', '"', '""', "back\\slash", "end\\", '\\"', "x\ny", "x\r\ny", "\n", "\r", "\t", "null", "#c", "src0", "src1", None]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """Texts without letters, missing ones, and names with spaces, quotes, backslashes and line breaks."""
    texts = ["", None, "12 34 .", "ACDE acde", "LRLRLRLR VRVRVRR 7", "ZZZ"]
    rows = [(n, texts[n % len(texts)], ODD[n % len(ODD)], ODD[(n * 5 + 3) % len(ODD)]) for n in range(len(ODD) * len(texts))]
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    some = [n for n in range(len(rows)) if n % 3]
    events = pa.table({"event_id": pa.array(some, pa.int64()), "value": pa.array([None if n % 7 == 0 else n / 4 for n in some], pa.float64())})
    return write(tmp_path_factory.mktemp("odd"), documents=docs, events=events)


def test_assay_file_of_odd_texts(spark, odd_dir):
    assert len(same(spark, odd_dir, "assay_round_trip")) == len(ODD) * 6


def test_sample_of_more_pairs_than_the_cap(spark, tmp_path):
    """4,600 items have 10,577,700 pairs, more than the ten million that the SQL numbers."""
    n = 4600
    items = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array([[0.5]] * n, pa.list_(pa.float32())), "label": pa.array([k % 5 for k in range(n)], pa.int32())})
    assert 4000 < len(same(spark, write(tmp_path, embeddings=items), "sample_pairs")) < 5000


@pytest.mark.parametrize("name", ["words_in_texts", "words_in_no_text", "candidates_in_texts", "candidates_in_texts_means"])
def test_words_of_odd_texts(spark, odd_dir, name):
    same(spark, odd_dir, name)


def test_words_are_told_before_the_shuffle(spark, monkeypatch):
    """Copies in one part of a task are one row, parts end between texts, and few words but those that pass leave it."""
    monkeypatch.setattr(candidates, "AT_ONCE", 30)
    texts = ["LRLRLRLRVRRVRV", "lrl rlr\u00e9l", "", None, "GGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGG", "RRVRRVV K ACDEF", "AC", "LRLRLR", "L"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    seqs = ["".join(c for c in (t or "").upper() if c in ALPHABET) for t in texts]
    every = {s[i : i + 7] for s in seqs for i in range(len(s) - 6)}
    found = {r.word for r in candidates.distinct_words_in(rows, 7, "text", raw=True).collect()}
    few = {r.word for r in candidates.distinct_words_in(rows, 7, "text", promising=True, raw=True).collect()}
    assert found == every and few < every
    passing = candidates.emitted(spark.createDataFrame([(0, w) for w in sorted(every)], "num long, word string")).select("seq").distinct().collect()
    assert passing and {r.seq[:7] for r in passing} <= few
    counts = {r.word: r.texts for r in candidates.words_in(spark.createDataFrame([(s,) for s in seqs], "seq string"), 7).collect()}
    assert counts == {w: sum(w in s for s in seqs) for w in every}
    batches = candidates._numbers_in(7, False, True, True)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert sum(b.num_rows for b in batches) < sum(max(len(s) - 6, 0) for s in seqs) / 2


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


@pytest.mark.parametrize("most", [500_000, 40])
def test_keys_are_numbered_without_their_rows(spark, monkeypatch, most):
    monkeypatch.setattr(indexing, "RANGE_ROWS", most)
    rows = spark.range(100).select((F.col("id") * 7 % 100 * 3).alias("k"), F.lit("long text").alias("wide"))
    found = indexing.dense_index(rows, "k", "n")
    assert found.columns == ["k", "wide", "n"] and sorted((r.k, r.n) for r in found.collect()) == [(3 * n, n) for n in range(100)]
    windows = [n for n in _nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not any("wide" in n.output().mkString(",") for n in windows)


def test_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """The last doubling of 3,000 ids is half of them, and no one file."""
    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    n = 3000
    docs = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(["ACDEF" * (1 + k % 3) for k in range(n)]), "lang": pa.array(["en" if k % 3 else "de" for k in range(n)]), "source": pa.array(["src1"] * n), "n_chars": pa.array([5] * n, pa.int64())})
    events = pa.table({"event_id": pa.array(range(0, n, 2), pa.int64()), "value": pa.array([1.5] * (n // 2), pa.float64())})
    folder = write(tmp_path, documents=docs, events=events)
    same(spark, folder, "files_in_order")
    written = {f for f in QUERIES["files_in_order"](spark, folder).inputFiles() if f.endswith(".csv")}
    sizes = [spark.read.option("header", True).csv(f).count() for f in sorted(written)]
    assert sum(sizes) == n and max(sizes) <= 400
