"""Removal of byte passages that repeat across documents, by suffix sorting with bucket-pointer refinement.

A byte goes if a string of `length` bytes covers it that also starts in a document of a smaller id. To sort
only suffixes that can repeat, each window of `length` bytes is known by its anchor, the leftmost of its
least-hashed `GRAM`-byte strings: equal windows have equal anchors at the same place, and one anchor stands
for a run of windows, about seventeen of them.

1. Texts are packed into units of about a megabyte, compressed and written down once. Several units make a
   pack; what packs and buckets send each other are rows of a pack and a bucket, as rows of each unit and
   bucket would grow with the square of the input.
2. Each unit finds, for each distinct anchor with its whole context (all bytes of its windows), a hash of
   the anchor, a name of the context (96 bits), two hashes of bytes beside the anchor and the least document;
   its pack sends them to the anchor's bucket. Copies in a unit have become one by then.
3. A bucket answers: contexts that a smaller document has in full are covered. Of an anchor with several
   contexts, those need a finer look that share bytes beside the anchor with one of another document: a window
   reaches half its rest or more to the left of its anchor or to the right, so contexts that differ on both
   sides share none. Chance repeats of an anchor end here; their part grows with the input.
4. The packs with the least document of such contexts send the contexts' bytes to the bucket. There, some
   anchors at a time, all suffixes are put in buckets by their first eight bytes; a suffix's pointer is the
   place where its bucket ends. Buckets of several suffixes are refined by sorting on the pointers at later
   offsets (8, 16, 32, ...), which that round rewrites in place, so that the next one sorts on refined
   pointers, until equal pointers mean equal windows; suffixes alone in a bucket drop out. A window is covered
   if its bucket holds one of a smaller document.
5. Every pack joins its answers, repeats those of a context at its other places in the unit, and cuts its
   texts.

Copies of a whole context are thus known by its name beside the anchor's hash, some 140 bits, as first buckets
of long strings; their bytes are not compared.

Defined results: null text is empty text; null ids count as larger than all others; documents of equal
ids never cover each other; repeated rows get a row each; other columns are ignored; an empty table gives no
rows. A very long text is a unit and a pack of its own, held in one task with some 100 bytes for each of its
bytes. An anchor of very many contexts that share more has their bytes in one task, those of different contexts
once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, bytes_of, cut, cut_by, free, mixed, pieces_of, powers, prepare, trim

LENGTH, GRAM = 50, 16
#: Units of a pack, at most as many times PIECE_BYTES of text or one unit.
PACK_UNITS = 8
#: Bytes of text that one bucket's anchors stand for, and bytes of contexts that a finer look takes at once, or one anchor's.
BUCKET_BYTES, LOOK_BYTES = 6 << 20, 2 << 20
NO_ID = np.iinfo(np.int64).max

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Unit:
    """Texts of a unit end to end, with their ids, and the anchors of all windows."""

    def __init__(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int):
        self.data, self.at, self.ids, self.length = data, at, ids, length
        empty = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.doc = self.left = self.right = empty
        self.group, self.context, self.context_too = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.before = self.after = np.zeros(0, np.uint16)
        n, width = len(data), length - GRAM + 1
        if n < length:
            return
        table = mixed(np.arange(1, 257, dtype=np.uint64))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * powers(n, BASE))))
            back = powers(n + 1, INVERSE)
            gram = mixed((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
        key = gram >> np.uint64(32) << np.uint64(32) | np.arange(len(gram), dtype=np.uint64)
        least, have = key, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        start = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
        if not len(start):
            return
        anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = owner[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        self.anchor, self.doc = anchor[head], own[head]
        self.low, self.high = start[head], start[np.append(head[1:], len(start)) - 1]
        self.left = np.maximum(self.anchor - (width - 1), at[self.doc])
        self.right = np.minimum(self.anchor + length, at[self.doc + 1])
        with np.errstate(over="ignore"):
            inside = (total[self.right] - total[self.left]) * back[self.left]
            shape = (self.anchor - self.left).astype(np.uint64) * np.uint64(256) + (self.right - self.anchor).astype(np.uint64)
            self.context = mixed(inside + mixed(shape + np.uint64(7)))
            # The strings that lie end to end in the context, the last one set back: no algebra over bytes.
            more = shape
            for k in range(0, 2 * length, GRAM):
                more = mixed(more * np.uint64(5) + gram[np.minimum(self.left + k, self.right - GRAM)])
            self.context_too = (more >> np.uint64(32)).astype(np.uint32)
            self.group = mixed(gram[self.anchor] + np.uint64(0x5851F42D4C957F2D))
        # Of each window's rest beside the anchor, half or more lies on one side; 0 where no window of the run has it there.
        half = width // 2
        self.before = np.where(self.anchor - self.low >= half, _side(gram[np.maximum(self.anchor - half, 0)]), np.uint16(0))
        self.after = np.where(self.high + length - self.anchor - GRAM >= half, _side(gram[np.minimum(self.anchor + half, len(gram) - 1)]), np.uint16(0))

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """One anchor of the least document for each distinct (group, context), in ascending order; and the number of its record for each anchor."""
        order = np.argsort(self.group)
        again, several = self.group[order][1:] == self.group[order][:-1], np.zeros(len(order), bool)
        several[1:] = again
        several[:-1] |= again
        k = order[several]  # the rest are alone in their group
        order[several] = k[np.lexsort((self.ids[self.doc[k]], self.context[k], self.group[k]))]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (self.group, self.context, self.context_too)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], number


def _side(gram: np.ndarray) -> np.ndarray:
    return np.maximum(gram >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def _texts_of(pack: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The units of a pack in the order of their numbers: bytes, offsets of texts, ids."""
    import zstandard

    for _, blob, at, ids in sorted(zip(*(pack.column(name).to_pylist() for name in ("unit", "blob", "at", "ids")), strict=True)):
        data = np.frombuffer(zstandard.decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
        yield data, np.frombuffer(at, np.int64), np.frombuffer(ids, np.int64)


def _units(docs: DataFrame) -> DataFrame:
    """Units of about a megabyte: pack, unit, blob (compressed texts), at (offsets), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first, many, total = number, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, many, total
            data = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([np.diff(x[1]) for x in held])
            at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            ids = np.concatenate([x[2] for x in held])
            held.clear()
            number += 1
            if many == PACK_UNITS or total + len(data) > PACK_UNITS * PIECE_BYTES:
                first, many, total = number, 0, 0
            many, total = many + 1, total + len(data)
            row = [pa.array([first], pa.int64()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack.compress(data.tobytes()) if len(data) else b"", at.tobytes(), ids.tobytes()))]
            return pa.RecordBatch.from_arrays(row, names=["pack", "unit", "blob", "at", "ids"])

        size = rows = 0
        for batch in batches:
            text, ids = batch.column(1).fill_null(""), batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for low, high in pieces_of(text):
                data, at = bytes_of(text.slice(low, high - low))
                if held and (size + len(data) > PIECE_BYTES or rows > 20_000):
                    yield flush()
                    size = rows = 0
                held.append((data, at, ids[low:high]))
                size += len(data)
                rows += high - low
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "pack bigint, unit bigint, blob binary, at binary, ids binary")


def _packed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(raw)


def _table(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([x[i] for x in rows], kind) for i, (name, kind) in enumerate(columns.items())})


def _records(units: DataFrame, buckets: int, length: int) -> DataFrame:
    """What each pack sends to each bucket: group, context (both its words), sides and id of its records there; base is the number of the first one, in the order of buckets and then of units."""
    columns = {"bucket": pa.int32(), "pack": pa.int64(), "base": pa.int64()} | dict.fromkeys(("groups", "contexts", "contexts_too", "befores", "afters", "least"), pa.binary())

    def run(pack: pa.Table) -> pa.Table:
        held = []
        for data, at, ids in _texts_of(pack):
            unit = Unit(data, at, ids, length)
            first, _ = unit.records()
            held.append([x[first] for x in (unit.group, unit.context, unit.context_too, unit.before, unit.after)] + [unit.ids[unit.doc[first]]])
            del unit
            trim()
        group, *facts = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        bucket = _bucket(group, buckets)
        order = np.argsort(bucket, kind="stable")
        there, begin = np.unique(bucket[order], return_index=True)
        end = np.append(begin, len(group))[1:]
        facts = [x[order] for x in ((group & np.uint64(0xFFFFFFFF)).astype("<u4"), *facts)]
        number = pack.column("pack")[0].as_py()
        return _table(columns, [(b, number, x, *(_short(fact[x:y]) for fact in facts)) for b, x, y in zip(there.tolist(), begin.tolist(), end.tolist(), strict=True)])

    return units.groupBy("pack").applyInArrow(run, "bucket int, pack bigint, base bigint, groups binary, contexts binary, contexts_too binary, befores binary, afters binary, least binary")


def _short(x: np.ndarray) -> bytes:
    """Ids as offsets of 32 bits from the first where they fit; other arrays as they are."""
    if x.dtype == np.int64 and len(x) and int(x.max()) - int(x.min()) < 1 << 32:
        low = int(x.min())
        return np.array([low], np.int64).tobytes() + (x - low).astype("<u4").tobytes()
    return x.tobytes()


def _ids(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 8 + 4 * n:
        return np.frombuffer(raw, "<u4", offset=8).astype(np.int64) + np.frombuffer(raw, np.int64, 1)
    return np.frombuffer(raw, np.int64)


def _bucket(group: np.ndarray, buckets: int) -> np.ndarray:
    return ((group >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _answers(records: DataFrame) -> DataFrame:
    """For each pack and bucket: numbers of records whose context a smaller document has (covered), or that need the finer look (fine)."""

    def run(table: pa.Table) -> pa.Table:
        packs, bases = table.column("pack").to_pylist(), table.column("base").to_pylist()
        groups = [np.frombuffer(x, "<u4") for x in table.column("groups").to_pylist()]
        sizes = [len(x) for x in groups]
        kinds = {"contexts": np.uint64, "contexts_too": np.uint32, "befores": np.uint16, "afters": np.uint16}
        group, context, too, before, after = np.concatenate(groups), *(np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items())
        least = np.concatenate([_ids(x, n) for x, n in zip(table.column("least").to_pylist(), sizes, strict=True)])
        order = np.sort(group.astype(np.uint64) << np.uint64(32) | np.arange(len(group), dtype=np.uint64)).astype(np.uint32).astype(np.int64)
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        several = np.diff(np.append(np.flatnonzero(new), len(g)))[np.cumsum(new) - 1] > 1
        order = order[several]  # the rest are alone in their group
        order = order[np.lexsort((least[order], context[order], group[order]))]
        g, c, t, d = group[order], context[order], too[order], least[order]
        covered, fine = np.zeros(len(group), bool), np.zeros(len(group), bool)
        if len(order):
            new_c = np.ones(len(g), bool)
            new_c[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (t[1:] != t[:-1])
            covered[order] = d > d[new_c][np.cumsum(new_c) - 1]
            # Documents of equal ids may lie in several units; each of these looks for itself.
            order = order[~covered[order]]
            for side in (before, after):
                some = order[side[order] > 0]
                fine[some] |= _differ(group[some].astype(np.uint64) << np.uint64(16) | side[some], least[some])
        out, a = [], 0
        for pack, base, n in zip(packs, bases, sizes, strict=True):
            hit, look = np.flatnonzero(covered[a : a + n]) + base, np.flatnonzero(fine[a : a + n]) + base
            a += n
            if len(hit) or len(look):
                out.append((pack, hit.astype("<u4").tobytes(), look.astype("<u4").tobytes()))
        trim()
        return _table({"pack": pa.int64(), "covered": pa.binary(), "fine": pa.binary()}, out)

    return records.groupBy("bucket").applyInArrow(run, "pack bigint, covered binary, fine binary")


def _differ(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether rows of the same key have differing values."""
    order = np.argsort(key)
    k, v = key[order], value[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head, out = np.flatnonzero(new), np.zeros(len(k), bool)
    if len(head):
        out[order] = (np.minimum.reduceat(v, head) < np.maximum.reduceat(v, head))[np.cumsum(new) - 1]
    return out


def _starts_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Runs of window starts, those that touch made one, as rows (low, high)."""
    if not len(low):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1] + 1
    return np.stack([low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]], 1)


def _looks(units: DataFrame, answers: DataFrame, buckets: int, length: int) -> DataFrame:
    """With answers: runs of covered windows of each pack (bucket -1), other places of its contexts (bucket -2), and the contexts that each pack sends to buckets.

    Places are bytes of the pack, its units end to end. A unit sends a context once. Where it has it again, in
    documents of the same id, a row of places (first window, number of windows, distance) says from where to
    take the answer."""
    columns = {"bucket": pa.int32(), "pack": pa.int64(), "facts": pa.binary(), "bytes": pa.binary()}

    def run(pack: pa.Table, told: pa.Table) -> pa.Table:
        held = []
        for data, at, ids in _texts_of(pack):
            unit = Unit(data, at, ids, length)
            held.append((unit, *unit.records()))
            trim()
        bucket = np.concatenate([_bucket(unit.group[first], buckets) for unit, first, _ in held])
        order = np.argsort(bucket, kind="stable")  # as the records were sent
        covered, sought = np.zeros(len(order), bool), np.zeros(len(order), bool)
        for name, marked in (("covered", covered), ("fine", sought)):
            marked[order[np.frombuffer(b"".join(told.column(name).to_pylist()), "<u4")]] = True
        runs, places, facts, texts, offset, a = [], [], [], [], 0, 0
        for unit, first, record in held:
            hit, look = covered[a : a + len(first)], sought[a : a + len(first)]
            a += len(first)
            if len(first):
                # Within the unit, documents after the least one with the same context are covered too.
                gone = hit[record] | (unit.ids[unit.doc] > unit.ids[unit.doc[first]][record])
                runs.append(_starts_of(unit.low[gone], unit.high[gone]) + offset)
                k = first[look]
                again = look[record] & ~gone
                again[k] = False
                again, of = np.flatnonzero(again), first[record[again]]
                places.append(np.stack([unit.low[of] + offset, unit.high[of] - unit.low[of] + 1, unit.anchor[again] - unit.anchor[of]], 1))
                group = (unit.group[k] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                facts.append(np.stack([unit.ids[unit.doc[k]], group, *(x[k] + offset for x in (unit.left, unit.right, unit.low, unit.high))]))
                texts += [unit.data[x:y].tobytes() for x, y in zip(unit.left[k].tolist(), unit.right[k].tolist(), strict=True)]
            offset += len(unit.data)
        number, out = pack.column("pack")[0].as_py(), []
        if sum(map(len, runs)):
            out.append((-1, number, np.concatenate(runs).tobytes(), b""))
        if sum(map(len, places)):
            out.append((-2, number, _packed(np.concatenate(places).tobytes()), b""))
        if texts:
            chosen = bucket[sought]
            order = np.argsort(chosen, kind="stable")
            every, (there, begin) = np.concatenate(facts, 1)[:, order], np.unique(chosen[order], return_index=True)
            for b, x, y in zip(there.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
                out.append((b, number, _packed(every[:, x:y].tobytes()), _packed(b"".join([texts[i] for i in order[x:y].tolist()]))))
        return _table(columns, out)

    return units.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, "bucket int, pack bigint, facts binary, bytes binary")


def refine(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort windows of `length` bytes by bucket-pointer refinement: those that are not alone, and equal numbers for equal windows.

    data must reach at least 8 bytes past every window; length is 8 or more. A suffix's pointer is the place
    where its bucket ends; suffixes of one bucket share `depth` bytes, and those of different buckets do not.
    A round sorts the buckets that hold several suffixes on the pointers `step` bytes on, and writes the new
    buckets' ends in place. Suffixes that no later round looks up are left out of it."""
    n, depth, steps = len(data) - 7, 8, []
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    wanted = [np.zeros(n, bool)]
    wanted[0][start] = True
    for step in reversed(steps):
        before = wanted[0].copy()
        before[step:] |= wanted[0][:-step]
        wanted.insert(0, before)
    alive = np.flatnonzero(wanted[0])
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | data[k : k + n].astype(np.uint64)
    first = first[alive]
    order = np.argsort(first)
    alive, first = alive[order], first[order]
    key, place, pointer = first, np.arange(len(alive)), np.zeros(n, np.int64)
    for step, after in zip([*steps, 0], [*wanted[1:], None], strict=True):
        # Suffixes in order, each with its place; a bucket ends before the next one begins.
        new = np.ones(len(alive), bool)
        new[1:] = key[1:] != key[:-1]
        ends = np.append(np.flatnonzero(new)[1:], len(alive)) - 1
        bucket = np.cumsum(new) - 1
        pointer[alive] = place[ends][bucket]
        if not step:
            break
        several = (np.diff(ends, prepend=-1)[bucket] > 1) & after[alive]
        alive, place = alive[several], place[several]
        if not len(alive):
            break
        key = pointer[alive] * len(first) + pointer[alive + step]
        order = np.argsort(key, kind="stable")  # buckets stay where they are, so places do
        alive, key = alive[order], key[order]
    _, number, many = np.unique(pointer[start], return_inverse=True, return_counts=True)
    some = many[number] > 1
    return start[some], number[some]


def _fine(looks: DataFrame, length: int) -> DataFrame:
    """Runs of windows that a smaller document covers, from contexts compared byte by byte."""

    def run(table: pa.Table) -> pa.Table:
        packs = table.column("pack").to_pylist()
        facts = [np.frombuffer(_unpacked(x), np.int64).reshape(6, -1) for x in table.column("facts").to_pylist()]
        data = np.frombuffer(b"".join(map(_unpacked, table.column("bytes").to_pylist())), np.uint8)
        owner = np.repeat(np.arange(len(packs)), [x.shape[1] for x in facts])
        ids, group, left, right, low, high = np.concatenate(facts, 1)
        size = right - left
        base = np.cumsum(size) - size
        out: dict[int, list[np.ndarray]] = {}
        for some in _slices(group, size):
            here = np.cumsum(size[some]) - size[some]
            bytes_here = np.concatenate((data[np.arange(size[some].sum()) + np.repeat(base[some] - here, size[some])], np.zeros(64, np.uint8)))
            context, start = _covered(bytes_here, here + low[some] - left[some], high[some] - low[some] + 1, ids[some], length)
            at, of = start - here[context] + left[some][context], owner[some][context]
            order = np.argsort(of, kind="stable")
            there, begin = np.unique(of[order], return_index=True)
            for k, x, y in zip(there.tolist(), begin, np.append(begin, len(of))[1:], strict=True):
                mine = at[order[x:y]]
                out.setdefault(k, []).append(_starts_of(mine, mine))
        trim()
        return _table({"pack": pa.int64(), "facts": pa.binary()}, [(packs[k], np.concatenate(x).tobytes()) for k, x in out.items()])

    return looks.where("bucket >= 0").groupBy("bucket").applyInArrow(run, "pack bigint, facts binary")


def _slices(group: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of contexts, those of a group together, in parts of at most LOOK_BYTES or of one group."""
    order = np.argsort(group, kind="stable")
    total, g = np.cumsum(size[order]), group[order]
    ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
    a = before = 0
    while a < len(g):
        most = np.searchsorted(total, before + LOOK_BYTES, "right")
        k = np.searchsorted(ends, most, "right") - 1
        b = int(ends[k]) if k >= 0 and ends[k] > a else int(ends[np.searchsorted(ends, a, "right")])
        yield order[a:b]
        a, before = b, int(total[b - 1])


def _covered(data: np.ndarray, first: np.ndarray, many: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a context of a smaller document has too: their contexts and starts. A context has `many` windows from its `first` start on."""
    which = np.repeat(np.arange(len(ids)), many)
    start = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
    number = np.full(len(data), -1)
    number[start] = which  # windows of different contexts lie in different bytes
    kept, bucket = refine(data, start, length)
    of = number[kept]
    order = np.lexsort((ids[of], bucket))
    b, d = bucket[order], ids[of][order]
    new = np.ones(len(b), bool)
    new[1:] = b[1:] != b[:-1]
    gone = order[d > d[new][np.cumsum(new) - 1]]
    return of[gone], kept[gone]


def _again(places: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows at further places (first window, number of windows, distance) of windows that runs cover."""
    covered = np.zeros(n + 1, np.int32)
    np.add.at(covered, low, 1)
    np.add.at(covered, high + 1, -1)
    first, many, distance = places.T
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
    return (start + np.repeat(distance, many))[np.cumsum(covered)[start] > 0]


def _cut_texts(units: DataFrame, runs: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes as text."""

    def cut_unit(data: np.ndarray, at: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, low, 1)
        np.add.at(step, high + length, -1)
        if len(places):
            start = _again(places, low, high, len(data))
            np.add.at(step, start, 1)
            np.add.at(step, start + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        first[heads] = gone[heads]
        removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, first))
        kept = data[~gone].tobytes()
        ends = (at - removed[at]).tolist()
        texts = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        per = lambda x: pa.array((x[at[1:]] - x[at[:-1]]).astype(np.int64))
        columns = [pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(at)), per(removed), per(spans), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            # A cut may part the bytes of a character; such halves go.
            columns.append(pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string()))
            names.append("kept_text")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(pack: pa.Table, told: pa.Table) -> pa.Table:
        facts, is_places = told.column("facts").to_pylist(), told.column("places").to_pylist()
        found = np.frombuffer(b"".join(x for x, y in zip(facts, is_places, strict=True) if not y), np.int64).reshape(-1, 2)
        places = np.frombuffer(b"".join(_unpacked(x) for x, y in zip(facts, is_places, strict=True) if y), np.int64).reshape(-1, 3)
        out, offset = [], 0
        for data, at, ids in _texts_of(pack):
            mine, too = ((x[:, 0] >= offset) & (x[:, 0] < offset + len(data)) for x in (found, places))
            low, high = (found[mine] - offset).T
            out.append(cut_unit(data, at, ids, low, high, places[too] - np.array([offset, 0, 0])))
            offset += len(data)
            trim()
        return pa.Table.from_batches(out)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    return units.groupBy("pack").cogroup(runs.groupBy("pack")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """For documents (doc_id of whole numbers, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256(, kept_text)."""
    spark = docs.sparkSession
    prepare(spark)
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    units = cut_by(_units(docs), parts, "pack")
    free(spark)
    size = units.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    buckets = max(parts, -(-3 * size // BUCKET_BYTES))
    answers = cut(_answers(_records(units, buckets, length)))
    free(spark)
    looks = cut(_looks(units, answers, buckets, length))
    del answers
    free(spark)
    told = looks.where("bucket < 0").select("pack", "facts", (F.col("bucket") == -2).alias("places"))
    runs = told.union(_fine(looks, length).withColumn("places", F.lit(False)))
    return _cut_texts(units, runs, length, with_text)
