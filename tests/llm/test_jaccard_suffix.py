"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from peptrail.llm import components, jaccard, suffix_dedup
from tests.llm.frames import DOCS, clashing, empty, odd, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=120):
    """Documents with copies, near copies, shared passages and some noise."""
    r = random.Random(seed)
    vocabulary = [("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            text = r.choice(out)[1]
        elif out and kind < 0.5:
            words = (r.choice(out)[1] or "a").split(" ")
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 30, 100, 200])))
            if kind > 0.8:
                text += " é " + passage
        out.append((i * 3 + 1, text, "en", "s", len(text)))
    r.shuffle(out)
    return out


def sets(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    s = {x[0]: sets(x[1]) for x in rows}
    ids, links, root = sorted(s), {}, {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, find(i), links.get(i, 0)) for i in ids}


@pytest.mark.parametrize(("seed", "tile"), [(1, 512), (2, 3)])
def test_groups(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = corpus(seed)
    found = jaccard.groups(clashing(spark.createDataFrame(rows, DOCS)))
    assert {tuple(r) for r in found.collect()} == brute_groups(rows)
    kept = jaccard.keep_first(spark.createDataFrame(rows, DOCS))
    assert {r.doc_id for r in kept.collect()} == {a for a, b, _ in brute_groups(rows) if a == b}


def test_links_of_a_block_need_no_shared_band(spark):
    """Four bands of six join the near copies to a block, but part of its pairs share none."""
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(40):
        mine = list(words)
        for k in r.sample(range(300), 3):
            mine[k] = f"x{i}"
        rows.append((i, " ".join(mine)))
    assert jaccard.choose_bands(0.8, 0.6, 24) == (4, 6)
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), recall=0.6, most_hashes=24)
    assert set(brute_groups(rows)) == {(k, 0, 39) for k in range(40)}
    block = [x for x in found.collect() if x.class_id == 0]  # so low a recall leaves some documents out
    assert len(block) >= 30 and {x.n_links for x in block} == {len(block) - 1}


def test_odd_rows(spark):
    found = sorted(((r.doc_id or 0, r.n_links) for r in jaccard.groups(odd(spark)).collect()))
    assert found == [(0, 0), (1, 2), (2, 0), (3, 0), (4, 0), (5, 2), (5, 2), (6, 0), (7, 0), (8, 0)]
    kept = jaccard.keep_first(clashing(odd(spark)))
    assert {r["_key"] for r in kept.collect()} == {"x"}
    assert kept.count() == 8 and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert jaccard.groups(empty(spark)).count() == 0


def test_few_words_in_a_batch(spark):
    """Tables of one to six words in all, alone in their batches, and texts that polynomial hashes take for each other."""
    words = ["one", "two", "three", "four", "five", "six"]
    for n in range(1, 7):
        assert len(jaccard.grams(pa.array([" ".join(words[:n])]))[0]) == max(1, n - 4)
        if n not in (2, 3):
            continue
        rows = [(1, " ".join(words[:n])), (2, " ".join(words[:n])), (3, words[-1] + "x")]
        found = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
        assert {tuple(r) for r in found.collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}
    texts = thue_morse(6, 7, 11)
    spaced = [" ".join(x) for x in texts[:4]] + texts[4:]
    assert len({g.tobytes() for g in jaccard.grams(pa.array([x + " a b c d" for x in texts]))}) == len(texts)
    found = jaccard.groups(spark.createDataFrame([(k, x, None, None, None) for k, x in enumerate(spaced)], DOCS).coalesce(1))
    assert {tuple(r) for r in found.collect()} == brute_groups(list(enumerate(spaced)))


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.999, 192)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (192 // (rows + 1)) < 0.999


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 1000, np.uint64)
    signer = jaccard.Signer(192, 1)
    same = (signer.band_hashes(np.sort(x[:900])) == signer.band_hashes(np.sort(x[100:]))).mean()
    assert abs(same - 0.8) < 0.1


def test_grams_are_those_of_words():
    texts = ["a b c d e f", "a b c d e", "a b", "", None, "x  y\tz", "a b c d e f"]
    found = jaccard.grams(pa.array(texts, pa.string()).fill_null(""))
    assert [len(g) for g in found] == [len(sets(t)) for t in texts]
    assert found[0].tolist() == found[6].tolist() and set(found[1].tolist()) < set(found[0].tolist())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(30)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for e in edges for x in e if find(x) != x}
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(x) for x in found.collect()} == want


def brute_repeats(rows, length=50):
    seen, out = {}, {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            seen[w] = min(seen.get(w, i), i)
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repeats(spark, seed):
    rows = corpus(seed)
    rows.append((2000, "z" * 400, "en", "s", 400))
    rows.append((2001, "y" + "z" * 300 + "x", "en", "s", 302))
    found = suffix_dedup.remove_repeats(clashing(spark.createDataFrame(rows, DOCS)))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute_repeats(rows)


def test_repeats_of_odd_rows(spark):
    found = suffix_dedup.remove_repeats(odd(spark), with_text=True).collect()
    assert len(found) == 10
    five = [r for r in found if r.doc_id == 5]
    assert [r.n_removed == r.n_bytes > 0 for r in five] == [True, True] and all(r.kept_text == "" for r in five)
    assert [r.n_removed for r in found if r.doc_id != 5] == [0] * 8
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_at_every_place(spark):
    """A context that a document has more than once is cut at each place, also where its id comes again in another unit."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    rows = [
        (1, "a" + "z" * 60 + "b"), (2, "z" * 400), (3, "x" + "-+" * 40 + "y"), (4, word(9) + "-+" * 300 + word(9)), (5, "z" * 55),
        (10, word(200) + passage[20:130] + word(200)), (11, passage + word(300) + passage + word(40) + passage), (12, word(20) + passage),
    ]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_repeats(rows)
    assert want[2][1] == 400
    assert {x.doc_id: tuple(x)[1:] for x in found.collect()} == want
    # Documents without an id, in units of their own, after a smaller one with a part of their passage.
    rows = [(1, "#" + passage[20:130] + "#"), *((None, word(30) + passage + word(30)) for _ in range(4))]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sorted(x.n_removed for x in found.collect()) == [0, 110, 110, 110, 110]


def test_rows_of_packs_and_buckets(spark, monkeypatch):
    """What is sent to buckets is a row of several units, so that rows do not grow with the square of the input."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "pieces_of", lambda text, cut=suffix_dedup.pieces_of: cut(text, 3000))
    sent, records = [], suffix_dedup._records

    def kept(units, buckets, length):
        sent.append((units.count(), out := records(units, buckets, length)))
        return out

    monkeypatch.setattr(suffix_dedup, "_records", kept)
    rows = corpus(6, 300)
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).coalesce(1))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute_repeats(rows)
    units, out = sent[0]
    assert units > 40 and out.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= units / 4


def test_chance_repeats_of_an_anchor_end_early(spark, monkeypatch):
    """Contexts that share little more than their anchor are not sent to be sorted; those that share a window are."""
    looks, fine = [], suffix_dedup._fine
    monkeypatch.setattr(suffix_dedup, "_fine", lambda x, length: (looks.append(x), fine(x, length))[1])
    r = random.Random(14)
    other = lambda n: "".join(r.choice("0123456789ABCDEF") for _ in range(n))
    rows = [(k, other(60) + "the same old string" + other(60)) for k in range(60)]
    shared = [(100 + k, other(20) + f"{k // 2:02}" + "of two documents, at the same old string of both" + other(20)) for k in range(6)]
    for docs, many in ((rows, 0), (rows + shared, 6)):
        found = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"))
        assert {x.doc_id: tuple(x)[1:] for x in found.collect()} == brute_repeats(docs)
        assert (looks[-1].where("bucket >= 0").count() > 0) == (many > 0)


def test_slices_keep_a_group_together(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOOK_BYTES", 100)
    r = np.random.default_rng(15)
    group, size = r.integers(0, 40, 300), r.integers(1, 30, 300)
    slices = list(suffix_dedup._slices(group, size))
    assert sorted(np.concatenate(slices).tolist()) == list(range(300))
    every = [set(group[x].tolist()) for x in slices]
    assert sum(map(len, every)) == len(set(group.tolist())) and all(size[x].sum() <= 100 or len(y) == 1 for x, y in zip(slices, every, strict=True))


def test_anchor_of_many_contexts(spark):
    """One string that 20,000 documents hold between bytes of their own, and in a third of them within a longer copy."""
    r = random.Random(12)
    other = lambda n: "".join(r.choice("0123456789ABCDEF") for _ in range(n))
    hot = "the same old string"
    rows = [(k, other(30) + hot + other(30) if k % 3 else "<" + hot + f"{k % 7}" * 40) for k in range(20_000)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {x.doc_id: tuple(x)[1:] for x in found.collect()} == brute_repeats(rows)


def test_patterns_of_two_letters(spark):
    """Thue-Morse words, their complements and powers of two letters, whose polynomial hashes meet."""
    texts = thue_morse(6, 7, 9)
    rows = [(k, x) for k, x in enumerate([*texts, *(x[::-1] for x in texts), "ab" * 100, "ba" * 80, *(x[7:] + "c" for x in texts)])]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {x.doc_id: tuple(x)[1:] for x in found.collect()} == brute_repeats(rows)


@pytest.mark.parametrize("length", [8, 20, 32, 50, 77])
def test_refinement(length):
    r = np.random.default_rng(length)
    data = np.concatenate([r.integers(0, 2, 4000), np.tile(r.integers(0, 2, 90), 4)]).astype(np.uint8)
    start = np.arange(len(data) - length + 1)
    kept, bucket = suffix_dedup.refine(np.concatenate([data, np.zeros(64, np.uint8)]), start, length)
    groups = {}
    for s in start.tolist():
        groups.setdefault(data[s : s + length].tobytes(), []).append(s)
    want = sorted(tuple(g) for g in groups.values() if len(g) > 1)
    got = {}
    for s, b in zip(kept.tolist(), bucket.tolist(), strict=True):
        got.setdefault(b, []).append(s)
    assert sorted(tuple(sorted(g)) for g in got.values()) == want


def test_components_end_once_links_are_stars(spark, monkeypatch):
    """Links that are stars take no step, and the last step is followed by none that only shows that nothing changes."""
    from peptrail.llm import components as module

    steps, step = [], module._small_star
    monkeypatch.setattr(module, "_small_star", lambda *a: steps.append(1) or step(*a))
    found = lambda pairs: {r.node: r.root for r in module.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found([(5, 1), (3, 1), (8, 7)]) == {5: 1, 3: 1, 8: 7} and not steps
    assert found([(2, 1), (3, 2)]) == {2: 1, 3: 1} and len(steps) == 1


@pytest.mark.parametrize("hot", [1, 3])
def test_components_with_hubs_on_either_side(spark, monkeypatch, hot):
    """Nodes of many smaller or larger neighbours meet their edges by a broadcast."""
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    low = [(50, k) for k in range(20, 50)]  # a hub above its neighbours
    high = [(k, 100) for k in range(101, 130)]  # a hub below them
    paths = [(k, k + 1) for k in range(200, 212)] + [(100, 205), (212, 50)]
    edges = low + high + paths + [(400, 401), (401, 402)]
    nodes = {x for e in edges for x in e}
    want = {(x, 400 if x >= 400 else 20) for x in nodes} - {(20, 20), (400, 400)}
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(x) for x in found.collect()} == want


def test_components_take_few_stages(spark):
    """A round has no stages for looks and broadcasts of their own: each stage has as many tasks as there are shuffle partitions."""
    edges = spark.createDataFrame([(2, 1), (3, 2), (8, 7)], "a bigint, b bigint").coalesce(1)
    context, group = spark.sparkContext, "components-few-stages"
    context.setJobGroup(group, group)
    try:
        found = components.components(edges).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(x) for x in found} == {(2, 1), (3, 1), (8, 7)}
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    infos = [x for s in stages if (x := tracker.getStageInfo(s))]
    assert len([x for x in infos if x.numCompletedTasks]) <= 15  # 26 before


def test_components_of_a_tile_are_stars():
    """A chain of links leaves a tile as a star around its least node, so that no step has to shorten it."""
    hit = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)
    node = np.array([9, 5, 2])
    assert sorted(jaccard._forest(hit, node, node)) == [(5, 2), (9, 2)]
