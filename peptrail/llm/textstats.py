"""Counts over whole texts, many texts at once: words, characters, symbols, lines, repeats."""

from __future__ import annotations

import numpy as np

from .common import hashed_twice, mixed, words_of

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER, LOWER, MARKS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = LOWER[97:123] = True
MARKS[ord("!")] = True


def repeats(one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of texts, in order, known by two hashes: whether the text holds an equal one before, and whether it holds another one."""
    with np.errstate(over="ignore"):
        both = mixed(one + mixed(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s, t, u = both[order], two[order], owner[order]
    same = np.zeros(len(s), bool)
    same[1:] = (s[1:] == s[:-1]) & (t[1:] == t[:-1]) & (u[1:] == u[:-1])
    later = np.zeros(len(s), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    any_other = np.zeros(len(s), bool)
    any_other[order] = twice
    return later, any_other


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Whole-number counts for each of the texts laid end to end.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines (equal to an
    earlier line with a word), n_repeat_words (words in 3-word windows that the text holds twice or more),
    n_distinct (words), n_upper, n_lower (ASCII letters), n_marks (exclamation marks)."""
    n = len(at) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[at[1:]] - total[at[:-1]]).astype(np.int64)

    starts, ends, first = words_of(data, at)
    owner = np.repeat(np.arange(n), np.diff(first))
    heads = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    out = {"n_words": np.diff(first).astype(np.int64)}
    out["word_chars"] = np.bincount(owner, heads[ends] - heads[starts], n).astype(np.int64)
    for name, of in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_lower", LOWER), ("n_marks", MARKS)):
        out[name] = per_text(of[data])
    word = hashed_twice(data, starts, ends)
    later, _ = repeats(*word, owner)
    out["n_distinct"] = np.bincount(owner[~later], minlength=n).astype(np.int64)
    # Lines with a word: from one line feed or text border to the next.
    breaks = np.flatnonzero(data == 10)
    low = np.unique(np.concatenate((at[:-1], breaks + 1)))
    line = np.unique(np.searchsorted(low, starts, "right") - 1)
    begin = low[line]
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], at[np.searchsorted(at, begin, "right")] if len(begin) else 0)
    line_owner = np.searchsorted(at, begin, "right") - 1
    later, _ = repeats(*hashed_twice(data, begin, stop), line_owner)
    out["n_lines"] = np.bincount(line_owner, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n).astype(np.int64)
    covered = np.zeros(len(owner), bool)
    if len(owner) > 2:
        with np.errstate(over="ignore"):
            window = [mixed(mixed(w[:-2] * np.uint64(3) + w[1:-1]) * np.uint64(5) + w[2:]) for w in word]
        whole = owner[:-2] == owner[2:]
        _, twice = repeats(window[0][whole], window[1][whole], owner[:-2][whole])
        at_words = np.flatnonzero(whole)[twice]
        for k in range(3):
            covered[at_words + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n).astype(np.int64)
    return out
