"""Manifests, divergence of sources and archives, against brute force and by round trip."""

import collections
import gzip
import hashlib
import re
import zlib
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from peptrail.llm import divergence, merkle, warc
from peptrail.llm.common import new_folder, read
from tests.llm.frames import DOCS, ODD, clashing, empty, odd

# --- manifest ------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """The root and, for each node, the runs that it stands in: (left, right) by level."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(places):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            proofs[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        places = [p // 3 for p in places]
    return level[0], proofs


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of all rows, by plain lists."""
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[3]].append((row[0], leaf(row)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([d for _, d in sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        ordered = sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out += [(i, d, trees[s][0], root, trees[s][1][n] + above[k]) for n, (i, d) in enumerate(ordered)]
    return out


def proven(spark, docs, also=None):
    path = new_folder(spark, "manifest")
    return merkle.proofs(spark, path, merkle.write(docs, path, also))


def plain(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in rows), key=key)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 3, 4), (81, 82, 1, 9), (27, 28, 250), (6600, 5)])
def test_trees_of_every_shape(spark, sizes):
    rows = [(1000 * k + i, f"text {i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    assert plain(proven(spark, spark.createDataFrame(rows, DOCS)).collect()) == plain_of(manifest(rows))


def plain_of(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


def test_many_sources_and_odd_rows(spark):
    rows = ODD + [(100 + k, "x", "en", f"é{k}" if k % 2 else f"Z{k}", k) for k in range(100)] + [(500, "y", None, "", 1)]
    found = proven(spark, clashing(spark.createDataFrame(rows, DOCS)))
    assert plain(found.collect()) == plain_of(manifest(rows))


def test_folds_to_the_root_and_shows_tampering(spark):
    rows = [(i, f"one\ntwo {i}", "en", f"s{i % 3}", i) for i in range(200)] + [(200, None, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    found = proven(spark, docs, {"tampered": merkle.leaf({"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})})
    folded = found.select("doc_id", (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"), (merkle.fold(F.col("tampered"), F.col("proof")) == F.col("root")).alias("other")).collect()
    assert all(r.own for r in folded)
    assert [r.doc_id for r in folded if r.other] == [200]


def test_empty_manifest(spark):
    assert proven(spark, empty(spark)).count() == 0


def test_long_text_is_hashed_whole(spark):
    rows = [(1, "é" * 1_000_000, "en", "s", 1), (2, "é" * 999_999 + "e", "en", "s", 1)]
    assert {r.leaf for r in proven(spark, spark.createDataFrame(rows, DOCS)).collect()} == {leaf(r) for r in rows}


def test_tampered_ids_are_those_of_the_library(spark):
    ids = spark.range(3000).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in ids)


# --- divergence ----------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least_docs=10, top=10):
    """The audit by plain dictionaries over all groups and terms."""
    by_group, docs_with = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, _ in rows:
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        by_group[lang or "", source or ""].update(found)
        docs_with[lang or ""].update(set(found))
    out = []
    for lang in {k[0] for k in by_group}:
        kept = sorted(t for t, n in docs_with[lang].items() if n >= least_docs)
        groups = {s: c for (x, s), c in by_group.items() if x == lang}
        whole = collections.Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + Fraction(10**9 * (c[t] + 2), n + 2 * len(kept)).__floor__() for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = sorted(((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            terms = sorted((-apart(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit(docs):
    return sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_of_given_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert audit(docs) == audited([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])


def planted(sources, seed=1):
    """Documents of many sources: common words, words of a few sources, words of one, and groups without words."""
    import random

    r, rows = random.Random(seed), []
    for s in range(sources):
        for d in range(4):
            few = [f"few{k}" for k in range(12) if s % 12 in (k, (k + 1) % 12)]
            words = [*r.choices([f"Common{k}" for k in range(30)], k=40), *r.choices(few, k=r.randrange(1, 8)), *(f"Rare{k}é" for k in range(5) if s == 3 * k)]
            rows.append((len(rows), "" if s % 13 == 5 else " ".join(words), "xx" if s % 5 else "yy", f"s{s}", d))
    return rows


@pytest.mark.parametrize("light, block, terms", [(8, 64, 4096), (0, 64, 4096), (1000, 64, 4096), (3, 7, 5), (6, 16, 8)])
def test_both_parts_add_up_at_every_split(spark, monkeypatch, light, block, terms):
    for name, value in (("LIGHT", max(light, 1)), ("BLOCK", block), ("TERMS", terms)):
        monkeypatch.setattr(divergence, name, value)
    rows = planted(40)
    assert audit(spark.createDataFrame(rows, DOCS)) == audited(rows)


def test_audit_of_odd_rows(spark):
    rows = ODD * 12 + [(None, "MAIL mail ÄÖ İi", None, None, None)] * 11
    assert audit(clashing(spark.createDataFrame(rows, DOCS))) == audited(rows)
    assert audit(empty(spark)) == []
    few = ODD[:3]
    assert audit(spark.createDataFrame(few, DOCS)) == audited(few)


def test_audit_of_a_long_text(spark):
    rows = [(k, "Alpha beta7gamma " * (60_000 if k == 0 else 1 + k), "en", f"s{k % 3}", 1) for k in range(30)]
    assert audit(spark.createDataFrame(rows, DOCS)) == audited(rows)


def test_shares_beyond_63_bits(spark):
    row = spark.sql("select 50000000000 as c, 60000000001 as n, 7 as v").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (50000000000 + 2) // (60000000001 + 14)


# --- archives ------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"
LONG = "<p>" + "copy " * 50
SAMPLE = [
    (5, "http://a/5", LONG), (3, "http://a/3 x\r\ny?q=é+%41", LONG), (9, None, LONG), (None, "u", LONG), (3, "again", LONG), (9, "again", LONG),
    (1, "a", "short"), (2, "b", "short"), (4, "c", None), (6, "d", ""), (7, "e", "é" * 50), (8, "f", "é" * 50), (10, "g", "é" * 49), (11, "h", "é" * 49),
    (12, "i", "line\r\n\r\nWARC/1.1\r\n" * 10), (None, "j", "n" * 200), (None, "k", "n" * 200), (13, "l", "x" * 3_000_000),
]


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 100 and page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = html in first and first[html] != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def archived(spark, rows):
    from pyspark.sql import DataFrame

    path = new_folder(spark, "warc")
    warc.write(rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, PAGES).repartition(3), path)
    return path


def test_archive_round_trip(spark):
    path = archived(spark, SAMPLE)
    found = warc.read(spark, path)
    assert rows_of(found) == expected(SAMPLE) and found.where("not intact").count() == 0
    texts = {(r.page_id, bytes(r.payload).decode()) for r in warc.read(spark, path, payload=True).collect()}
    assert texts == {(i, html or "") for i, _, html in SAMPLE}


def test_archives_are_well_formed(spark):
    """Read file by file with the standard library alone: members of one record, each as long as it states."""
    path = archived(spark, SAMPLE)
    records = []
    for file in Path(path, "archive").iterdir():
        rest = file.read_bytes()
        while rest:
            member = zlib.decompressobj(31)
            raw = member.decompress(rest)
            rest = member.unused_data
            head, _, block = raw.partition(b"\r\n\r\n")
            names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and block[int(names["Content-Length"]) :] == b"\r\n\r\n"
            records.append(names)
    kinds = collections.Counter(r["WARC-Type"] for r in records)
    want = collections.Counter(r[3] for r in expected(SAMPLE))
    assert kinds["response"] == want["response"] and kinds["revisit"] == want["revisit"] and kinds["warcinfo"] >= 1
    ids = {r["WARC-Record-ID"] for r in records if r["WARC-Type"] == "response"}
    assert all(r["WARC-Refers-To"] in ids for r in records if r["WARC-Type"] == "revisit")


def test_chosen_records_only(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    path = archived(spark, pages.unionByName(pages.where("page_id < 5").withColumn("page_id", F.col("page_id") + 100_000)))
    found = warc.read(spark, path, F.col("page_id").isin(7, 100_003, 4), payload=True).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert {(r.page_id, bytes(r.payload).decode()) for r in found} == {(7, html[7]), (100_003, html[3]), (4, html[4])}
    assert {r.page_id: r.refers_to for r in found} == {7: None, 4: None, 100_003: 3}


def test_index_places_are_members(spark):
    path = archived(spark, SAMPLE)
    for r in spark.read.parquet(f"{path}/index").collect():
        raw = Path(path, "archive", r.file).read_bytes()[r.offset : r.offset + r.length]
        headers, _ = warc.parse(gzip.decompress(raw))
        assert headers["warc-payload-digest"] == f"sha256:{r.payload_digest}" and headers["warc-type"] == r.record_type


def test_ranges_close_together_are_one_read(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    ranges = [("a", 0, 10), ("a", 15, 10), ("a", 40, 5), ("a", 45, 90), ("b", 140, 500), ("b", 640, 1)]
    assert list(warc.spans(ranges)) == [ranges[:2], ranges[2:4], ranges[4:5], ranges[5:]]


def test_one_payload_on_most_pages(spark):
    """Groups met by broadcast and by shuffle, and all revisits of one response."""
    rows = [(k, "u", LONG) for k in range(3000)] + [(3000 + k, "u", f"{LONG} {k // 2}") for k in range(3000)]
    path = archived(spark, rows)
    assert rows_of(warc.read(spark, path)) == expected(rows)


def test_revisits_met_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "HOT_GROUPS", 1)
    assert rows_of(warc.read(spark, archived(spark, SAMPLE))) == expected(SAMPLE)


def test_damage_is_told(spark):
    path = archived(spark, [(1, "u", "a" * 200)])
    row = spark.read.parquet(f"{path}/index").first()
    payload = b"HTTP/1.1 200 OK\r\n\r\nother"
    raw = gzip.compress(warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", f"sha256:{row.payload_digest}"), ("Page-Id", "1")], payload))
    Path(path, "archive", "other").write_bytes(raw)
    place = spark.createDataFrame([("other", 0, len(raw))], "file string, offset bigint, length bigint")
    assert [r.intact for r in warc.fetch(spark, path, place, "bigint").collect()] == [False]


def test_other_ids_and_empty_pages(spark):
    named = spark.createDataFrame([("p é/1+2", "u", LONG), ("q", "u", LONG)], "page_id string, url string, html string").withColumn("offset", F.lit("x"))
    found = {r.page_id: r.refers_to for r in warc.read(spark, archived(spark, named)).collect()}
    assert found == {"p é/1+2": None, "q": "p é/1+2"}
    assert warc.read(spark, archived(spark, spark.createDataFrame([], PAGES))).count() == 0


def test_queries_over_odd_documents(spark, tmp_path):
    """The registered queries take odd rows as the operators do."""
    from peptrail.llm.queries import queries

    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(found) == len(ODD)
    assert all(r.verified for r in found if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2 or "\n" not in next(x[1] or "" for x in ODD if x[0] == r.doc_id))
    assert {r.doc_id for r in found if not r.verified} == {i for i, text, *_ in ODD if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (text or "")}
