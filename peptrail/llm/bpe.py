"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is parted into pre-tokens. For every prefix of a pre-token exactly one token can stand last; it is
a vocabulary entry that ends there (an automaton over the vocabulary lists these for each position) and
that may follow the last token of the prefix before it. Whether two tokens may stand side by side depends
on them alone. Back-pointers from the end give the ids that merging by rank would give.

The automaton is one over the whole vocabulary (Aho-Corasick): its failure links are the suffix links that a
suffix automaton of the entries would have, and it lists the entries that end at a place. Distinct chunks of
texts go through the programme once in a worker; `tokens.ChunkEncoder` looks up those it has met.

Defined results: null text is empty text, with no ids; repeated rows give a row each, and equal texts equal
ids (exactly one token can stand last, so there are no ties); other columns are ignored; an empty table
gives no rows. Very long texts are encoded whole; the memories of a worker are bounded by entries and bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, prepare
from .tokens import ChunkEncoder, byte_characters, default_tokenizer

#: Fixed value: the byte-level pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Remembered pairs of tokens of a worker; a full memory starts anew, with the same results.
CACHE_ENTRIES = 1_200_000

NEVER = 1 << 60


class PrefixEncoder:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = byte_characters()
        self.added_ids = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.added = list(self.added_ids)
        self.token: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in self.added_ids}
        by_bytes = {t: i for i, t in self.token.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for k, merge in enumerate(model["model"]["merges"]):
            left, right = (by_bytes[bytes(byte[c] for c in x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = by_bytes[self.token[left] + self.token[right]]
            self.rank[left, right] = k
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), k
        self.automaton = ahocorasick.Automaton()
        for i, t in self.token.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        output = [self.token.get(i, b"") for i in range(max([*self.token, *self.added_ids.values()]) + 1)]
        for t, i in self.added_ids.items():
            output[i] = t.encode()
        self.bytes_of_ids = Texts(output)
        self.decimals = Texts([b"%d," % i for i in range(len(output))])
        self.pre_tokens = regex.compile(PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The outermost parts of a token on a side, from its single byte to itself, each with the rank of the merge that ends it."""
        out, ends = [(token, NEVER)], self.born.get(token)
        while ends is not None:
            token = self.parts[token][side]
            out.append((token, ends))
            ends = self.born.get(token)
        return out[::-1]

    def may_meet(self, a: int, b: int) -> bool:
        """Whether merging by rank, leftmost first, over both tokens' bytes leaves their border as it is."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            left, right, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.rank.get((x, y), NEVER)
                if rank < x_ends and rank <= y_ends and rank < NEVER:
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def may_stand(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        known = self.alone.get(token)
        if known is None:
            a, b = self.parts.get(token, (token, -1))
            # The border between its two parts holds until the merge that makes the token.
            known = b < 0 or self.may_stand(a) and self.may_stand(b) and self._meets_at_last(a, b)
            self.alone[token] = known
        return known

    def _meets_at_last(self, a: int, b: int) -> bool:
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while (i, j) != (len(left) - 1, len(right) - 1):
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        return True

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        last, back = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        may_meet = self.may_meet
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length
                if may_meet(last[start], token) if start and last[start] >= 0 else not start and self.may_stand(token):
                    last[end], back[end] = token, start
        out, end = [], len(raw)
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def piece(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        return [i for w in self.pre_tokens(text) for i in self.word(w.encode())]

    def whole(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        found = [a for a in self.added if a in text]
        if not found:
            return np.array(self.piece(text), np.uint32)
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(found, key=len, reverse=True))) + ")")
        return np.array([i for x in cut.split(text) for i in ([self.added_ids[x]] if x in self.added_ids else self.piece(x))], np.uint32)

    def many(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, end to end, and their sizes."""
        ids = [self.piece(x.decode()) for x in chunks]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of_ids.laid(np.array(ids, np.int64))[0].decode("utf-8", "replace")


class Texts:
    """Short texts by number, laid end to end many at a time."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(texts), np.uint8)

    def laid(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The texts of ids in one, and where each ends, from 0 for none."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.data[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(int(ends[-1]))].tobytes(), ends


@functools.lru_cache(maxsize=2)
def prefix_encoder(path: str) -> ChunkEncoder:
    """One for each worker process and vocabulary file."""
    return ChunkEncoder(PrefixEncoder(path))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids of every document (doc_id, text)."""
    return _run(docs, tokenizer, True)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _run(docs, tokenizer, False)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids decode to empty text."""
    prepare(encoded.sparkSession)
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = prefix_encoder(tokenizer).coder
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def _run(docs: DataFrame, tokenizer: str | None, ids_too: bool) -> DataFrame:
    prepare(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(tokenizer)
        for batch in batches:
            text = batch.column(1).fill_null("")
            for low, high in pieces_of(text):
                doc_id = batch.column(0).slice(low, high - low)
                ids, at = encoder.encode(text.slice(low, high - low))
                if ids_too:
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([doc_id, lists], names=["doc_id", "ids"])
                    continue
                listed, ends = encoder.coder.decimals.laid(ids)
                # Without the comma after the last id.
                listed = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True)]
                raw, ends = encoder.coder.bytes_of_ids.laid(ids)
                decoded = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at).astype(np.int64)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, ids array<int>" if ids_too else f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
