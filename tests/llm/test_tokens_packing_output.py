"""Encoding, packing and token files against the library and by round trip."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peptrail.llm import bpe, packing, token_output, tokens
from tests.llm.frames import ODD, clashing, empty, odd, thue_morse

PATH = tokens.default_tokenizer()
TRICKY = ["", "  a", " \n b", "foo\n \nbar  baz   ", "a<|endoftext|> b  <|endoftext|>", "\t\t x  y's 's  ", "　 x 　", "\x1c a \x85 b\x1f  c", "a\r\n  \r\n b", " ", "a ", "ab, ñé. x1, ,.   z", " xy, xy xy.", "aaaaaaaaaaaaaa", "日本語 한국어 😀"]


def library(text):
    return tokens.encoder(PATH).coder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("end", [None, 2])
def test_chunks_give_whole_text_ids(end):
    ids, at = tokens.encoder(PATH).encode(pa.array([*TRICKY, None], pa.string()), end)
    for k, text in enumerate([*TRICKY, None]):
        assert ids[at[k] : at[k + 1]].tolist() == library(text) + ([end] if end else [])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é.,'\n\t12<|>ßж "), max_size=60))
def test_any_text(text):
    ids, _ = tokens.encoder(PATH).encode(pa.array([text, "x " + text]))
    assert ids.tolist() == library(text) + library("x " + text)
    own = bpe.prefix_encoder(PATH)
    assert own.encode(pa.array([text, "x " + text]))[0].tolist() == ids.tolist() and own.coder.decode(library(text)) == text


def test_table_knows_keys_by_their_bytes():
    table = tokens.Table(4)
    keys = [b"a", b"a\0", b"aaaaaaaa", b"aaaaaaaa\0", b"a" * 16, b"a" * 17, b"b" * 900]
    table.add(tokens.Runs.of(keys), np.arange(14, dtype=np.uint32), np.full(7, 2))
    ids, sizes = table.ids(table.find(tokens.Runs.of(keys)))
    assert ids.tolist() == list(range(14)) and sizes.tolist() == [2] * 7
    assert table.find(tokens.Runs.of([b"b", b"a\0\0", b"a" * 15, b"a" * 18])).tolist() == [-1] * 4


@pytest.mark.parametrize("name", ["SLOT_BITS", "MOST_IDS", "MOST_BYTES", "BLOCK"])
def test_small_memories_give_the_same_ids(monkeypatch, name):
    texts = pa.array([" ".join(f"w{k * j % 97}é, {'z' * (k % 40)}" for j in range(60)) for k in range(40)])
    want, at = tokens.encoder(PATH).encode(texts)
    monkeypatch.setattr(tokens, name, {"SLOT_BITS": 12, "BLOCK": 50}.get(name, 100))
    if name == "SLOT_BITS":
        monkeypatch.setattr(tokens, "BLOCK", 1000)
        monkeypatch.setattr(tokens.Table.__init__, "__defaults__", (12,))
    own = tokens.ChunkEncoder(tokens.encoder(PATH).coder)
    for _ in range(2):
        ids, there = own.encode(texts)
        assert ids.tolist() == want.tolist() and there.tolist() == at.tolist()


def test_texts_on_which_polynomial_hashes_collide(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    texts = thue_morse(10, 11, 12)
    ids, at = tokens.encoder(PATH).encode(pa.array(texts))
    own, _ = bpe.prefix_encoder(PATH).encode(pa.array(texts))
    assert ids.tolist() == own.tolist() == [i for x in texts for i in library(x)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r.ids_crc32 for r in packing.pack(df, 4096, PATH).collect()}
    assert found == {k: zlib.crc32(np.array([*library(x), 2], "<u4").tobytes()) for k, x in enumerate(texts)}


def test_round_trip_digests(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*TRICKY, None])], "doc_id bigint, text string").coalesce(1)
    for r in bpe.round_trip(df, PATH).collect():
        text = [*TRICKY, None][r.doc_id] or ""
        want = library(text)
        assert tuple(r)[1:] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_columns(spark):
    for df in (odd(spark), clashing(odd(spark))):
        found = bpe.round_trip(df, PATH).collect()
        assert sorted(r.n_tokens for r in found) == sorted(len(library(x[1])) for x in ODD)
    encoded = bpe.encode(odd(spark), PATH)
    assert sorted(r.text for r in bpe.decode(encoded, PATH).collect()) == sorted(x[1] or "" for x in ODD)
    assert bpe.round_trip(empty(spark), PATH).count() == 0


def brute_fullest(room, counts):
    reach = {0}
    for length, n in counts.items():
        reach = {s + length * k for s in reach for k in range(n + 1) if s + length * k <= room}
    return max(reach)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 30))
def test_fullest(counts, room):
    found = packing.fullest(room, counts)
    assert sum(found) == brute_fullest(room, counts) and all(found.count(x) <= counts[x] for x in found)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 2000), min_size=1, max_size=20))
def test_plan_uses_every_piece_once(counts):
    steps = packing.plan(counts, 40)
    used = {}
    for s in steps:
        assert sum(s.lengths) <= 40
        for x in s.lengths:
            used[x] = used.get(x, 0) + s.times
    assert used == counts
    bins, least = sum(s.times for s in steps), -(-sum(k * n for k, n in counts.items()) // 40)
    assert bins <= 2 * least


@pytest.mark.parametrize("shape", ["odd", "clash"])
def test_packing(spark, shape):
    df = odd(spark) if shape == "odd" else clashing(odd(spark))
    found = packing.pack(df, 64, PATH, with_ids=True).collect()
    assert sum(r.length for r in found) == sum(len(library(x[1])) + 1 for x in ODD)
    place = {}
    for r in found:
        assert len(r.ids) == r.length <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and (r.piece == 0 or r.length == 64)
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_rows_without_ids(spark):
    """Rows without an id are dealt to groups by their number, and two runs over the same rows place them alike."""
    rows = [(None, "word " * (k % 7)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs = [sorted((r.sequence_id, r.offset, r.length, r.ids_crc32) for r in packing.pack(df, 64, PATH).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 400
    total = sum(len(library(x[1])) + 1 for x in rows)
    assert len({x[0] for x in runs[0]}) == -(-total // 64)


def test_packing_nothing(spark):
    assert packing.pack(empty(spark), 64, PATH).count() == 0


def test_token_files(spark, tmp_path):
    df = clashing(odd(spark))
    token_output.write(df, f"{tmp_path}/t", PATH)
    files = token_output.read(spark, f"{tmp_path}/t").collect()
    assert sorted(tuple(r.ids) for r in files) == sorted((*library(x[1]), 0) for x in ODD)
    found = sorted(((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in token_output.digests(spark, f"{tmp_path}/t").collect()))
    at, last = 0, -1
    for start, n, doc_id, _ in found:
        assert start == at and (doc_id is None or doc_id >= last)
        at, last = at + n, last if doc_id is None else doc_id
    token_output.write(empty(spark), f"{tmp_path}/e", PATH)
    assert token_output.digests(spark, f"{tmp_path}/e").count() == 0


def test_files_have_small_groups_and_page_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_output.write(odd(spark), f"{tmp_path}/t", PATH)
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/t/*.parquet")]
    columns = [m.row_group(g).column(c) for m in meta for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert columns and all(c.has_column_index and c.has_offset_index for c in columns if c.path_in_schema == "doc_id")
    assert any("DICTIONARY" in e for c in columns for e in c.encodings)
