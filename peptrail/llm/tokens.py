"""Token ids of whole texts, each distinct chunk encoded once.

A text is cut before every space that a non-space character follows. Such a space always opens a new
pre-token of the byte-level pattern, whatever stands before it, so encoding the chunks one by one gives
the ids of the whole text. Texts that hold an added token's string, or white space after a space, are
encoded as they are.

A worker keeps the ids of the chunks it has met in a table whose keys are the chunks' bytes, so that equal
keys are equal chunks. It hands only new chunks to the coder: the tokenizers library here, or another one
with the same two methods.

Very long texts: a text is held whole, with its ids, beside arrays of some 60 bytes for each chunk of a
block of `BLOCK` chunks; the table is bounded by entries, ids and bytes.
"""

from __future__ import annotations

import functools
import os
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import FIRST_BYTES, PIECE_BYTES, bytes_of, mixed, pieces_of, wide

#: Slots of a worker's table (2 ** SLOT_BITS). Where it is half full, or its ids or longer keys pass these
#: bounds, it starts anew; results do not depend on it.
SLOT_BITS, MOST_IDS, MOST_BYTES = 22, 1 << 24, 1 << 25
#: Chunks looked up at once, fewer than half the slots.
BLOCK = 1 << 18
#: Chunks of up to so many bytes are keys as two words and a length; longer ones as bytes in a dictionary.
SHORT = 16

#: A space before white space or the end, for Arrow, whose \s is ASCII alone.
_ODD_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\pZ]|$)"
#: Marks that, after letters, are a pre-token of their own.
MARKS = b",."


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder(Protocol):
    """What turns texts into ids: any text, and many chunks of one pre-token or more each."""

    added: list[str]

    def whole(self, text: str) -> np.ndarray: ...

    def many(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (UTF-8), end to end, and their sizes."""


class Library:
    """The tokenizers library, without truncation and padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Characters that stand for bytes, in a byte-level vocabulary.
        self.spelt = {b: c for c, b in byte_characters().items()}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def many(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A space and letters are one pre-token, which the library's model takes as it is; other chunks go through the whole library."""
        model, spelt = self.tokenizer.model.tokenize, self.spelt
        parts: list[list[int]] = []
        for x in chunks:
            if x[0] == 32 and (text := x[1:].decode()).isalpha():
                parts.append([t.id for t in model("\u0120" + text if x.isascii() else x.decode("latin-1").translate(spelt))])
            else:
                parts.append(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter((i for x in parts for i in x), np.uint32, int(sizes.sum())), sizes


class Runs:
    """Non-empty runs of bytes as keys: up to `SHORT` bytes exactly as two words and a length."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends, self.sizes = data, starts, ends, ends - starts
        words = wide(data)
        self.low = words[starts] & FIRST_BYTES[np.minimum(self.sizes, 8)]
        self.high = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(self.sizes > 8)
        self.high[more] = words[starts[more] + 8] & FIRST_BYTES[np.minimum(self.sizes[more] - 8, 8)]
        self.short = np.flatnonzero(self.sizes <= SHORT)

    @classmethod
    def of(cls, keys: list[bytes]) -> Runs:
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
        return cls(np.frombuffer(b"".join(keys), np.uint8), np.concatenate(([0], ends[:-1])), ends)

    def raw(self, which: np.ndarray) -> list[bytes]:
        all_of = memoryview(np.ascontiguousarray(self.data))
        return [bytes(all_of[a:b]) for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]

    def slots(self, which: np.ndarray, mask: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(self.low[which] ^ mixed(self.high[which] + self.sizes[which].astype(np.uint64))) & mask).astype(np.int64)


class Table:
    """Ids by bytes: open addressing over arrays for short keys, looked up and filled many at a time; a dictionary for the rest."""

    def __init__(self, bits: int = SLOT_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.length, self.entry = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.int32)  # a length of 0 marks a free slot
        self.longer: dict[bytes, int] = {}
        self.longer_bytes = self.used = self.entries = 0
        self.start, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)

    def full(self) -> bool:
        return 2 * self.entries > len(self.low) or self.used > MOST_IDS or self.longer_bytes > MOST_BYTES

    def find(self, runs: Runs) -> np.ndarray:
        """The entry of each key, -1 for unknown ones."""
        out = np.full(len(runs.sizes), -1)
        rest = runs.short
        slot = runs.slots(rest, self.mask)
        while len(rest):
            there = self.length[slot]
            hit = (there == runs.sizes[rest]) & (self.low[slot] == runs.low[rest]) & (self.high[slot] == runs.high[rest])
            out[rest[hit]] = self.entry[slot[hit]]
            go = ~hit & (there != 0)
            rest, slot = rest[go], slot[go] + 1 & int(self.mask)
        if len(runs.short) < len(out):
            long = np.flatnonzero(runs.sizes > SHORT)
            out[long] = [self.longer.get(x, -1) for x in runs.raw(long)]
        return out

    def add(self, runs: Runs, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct keys with their ids, end to end."""
        n, many = self.entries, len(sizes)
        while n + many > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros(len(x), np.int32))) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + many], self.size[n : n + many] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.entries += many
        rest = runs.short
        slot = runs.slots(rest, self.mask)
        while len(rest):
            free = np.flatnonzero(self.length[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            at, k = slot[put], rest[put]
            self.low[at], self.high[at], self.length[at], self.entry[at] = runs.low[k], runs.high[k], runs.sizes[k], n + k
            go = np.ones(len(rest), bool)
            go[put] = False
            rest, slot = rest[go], slot[go] + 1 & int(self.mask)
        if len(runs.short) < many:
            long = np.flatnonzero(runs.sizes > SHORT)
            self.longer.update(zip(runs.raw(long), (n + long).tolist(), strict=True))
            self.longer_bytes += int(runs.sizes[long].sum())

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, end to end, and their sizes."""
        sizes = self.size[entry].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.start[entry] - first, sizes) + np.arange(int(sizes.sum()))], sizes


class ChunkEncoder:
    def __init__(self, coder: Coder):
        self.coder, self.table = coder, Table()
        self.marks = {m: coder.whole(chr(m)) for m in MARKS}

    def _add(self, keys: list[bytes]) -> dict[bytes, int]:
        """Encode and add distinct unknown chunks; their entries."""
        first = self.table.entries
        if keys:
            self.table.add(Runs.of(keys), *self.coder.many(keys))
        return {x: first + k for k, x in enumerate(keys)}

    def _learn(self, new: list[bytes]) -> dict[bytes, int]:
        """As `_add`. A chunk of letters and one mark is put together from its letters' ids and the mark's."""
        marked = [x for x in new if x[-1] in MARKS and len(x) > 2 and x[0] == 32 and x[1:-1].decode().isalpha()]
        if not marked:
            return self._add(new)
        apart = set(marked)
        entry = self._add([x for x in new if x not in apart])
        bases = list(dict.fromkeys(x[:-1] for x in marked))
        base = dict(zip(bases, self.table.find(Runs.of(bases)).tolist(), strict=True))
        base |= self._add([x for x, k in base.items() if k < 0])
        for m in MARKS:
            these = [x for x in marked if x[-1] == m]
            if these:
                first = self.table.entries
                inner, sizes = self.table.ids(np.array([base[x[:-1]] for x in these]))
                self.table.add(Runs.of(these), np.insert(inner, np.cumsum(sizes), self.marks[m][0]), sizes + 1)
                entry |= {x: first + k for k, x in enumerate(these)}
        return entry

    def encode(self, text: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (null: empty), end to end, each followed by the end id if one is given; and their len + 1 offsets."""
        text = text.fill_null("")
        alone = pc.match_substring_regex(text, _ODD_SPACE)
        for a in self.coder.added:
            alone = pc.or_(alone, pc.match_substring(text, a))
        odd = np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist()
        plain = pc.if_else(alone, "", text) if odd else text
        done = [self._chunked(*bytes_of(plain.slice(low, high - low))) for low, high in pieces_of(plain, PIECE_BYTES // 2)]
        ids, counts = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not odd and end_id is None:
            return ids, np.concatenate(([0], np.cumsum(counts)))
        parts, low, tail = [], 0, np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        if odd:
            for i in odd:
                counts[i] = -1
            for i, n in enumerate(counts.tolist()):
                parts += [self.coder.whole(text[i].as_py()) if n < 0 else ids[low : low + n], tail]
                low += max(n, 0)
            sizes = np.array([len(x) for x in parts], np.int64)
            return np.concatenate(parts) if parts else ids, np.concatenate(([0], np.cumsum(sizes[0::2] + sizes[1::2])))
        ends = np.cumsum(counts)
        return np.insert(ids, ends, end_id), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))

    def _chunked(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the number of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        opens = data == 32
        opens[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        done = [self._block(data, starts[k : k + BLOCK], ends[k : k + BLOCK]) for k in range(0, len(starts), BLOCK)]
        ids, sizes = (np.concatenate(x) for x in zip(*done, strict=True))
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(total[np.searchsorted(starts, at)])

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, end to end, and their sizes."""
        if self.table.full():
            self.table = Table()
        low = starts[0]
        runs = Runs(data[low : ends[-1]], starts - low, ends - low)
        entry = self.table.find(runs)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            raw = runs.raw(unknown)
            number = self._learn(list(dict.fromkeys(raw)))
            entry[unknown] = [number[x] for x in raw]
        return self.table.ids(entry)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One for each worker process and vocabulary file."""
    return ChunkEncoder(Library(path))
