"""Hashed word and character n-gram features, and a logistic scorer over them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .common import bytes_of, hashed, mixed, pieces_of, words_of

#: Buckets of words and as many of character n-grams; bytes of an n-gram.
BUCKETS, GRAM = 1 << 16, 4
#: Shares of a text's words (or n-grams) are small numbers; this brings them near one.
SCALE = 20.0


def buckets(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, then for character n-grams: buckets and the number of the text of each."""
    starts, ends, first = words_of(data, at)
    word = (hashed(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    own = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if len(data) < GRAM:
        return [(word, own), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    m = len(data) - GRAM + 1
    code = np.zeros(m, np.uint64)
    for k in range(GRAM):
        code = code << np.uint64(8) | data[k : k + m].astype(np.uint64)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    whole = owner[:m] == owner[GRAM - 1 :]
    gram = (mixed(code[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64) + BUCKETS
    return [(word, own), (gram, owner[:m][whole])]


def features(text: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sparse rows, one for each text: ascending buckets and their scaled shares."""
    keys, values = [], []
    for low, high in pieces_of(text):
        data, at = bytes_of(text.slice(low, high - low))
        rows, sums = [], []
        for bucket, owner in buckets(data, at):
            total = np.bincount(owner, minlength=high - low)
            key, n = np.unique(owner.astype(np.int64) * (2 * BUCKETS) + bucket, return_counts=True)
            rows.append(key)
            sums.append(SCALE * n / total[key // (2 * BUCKETS)])
        key, value = np.concatenate(rows), np.concatenate(sums)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        cuts = np.searchsorted(key, np.arange(1, high - low) * (2 * BUCKETS))
        keys += np.split((key % (2 * BUCKETS)).astype(np.int32), cuts)
        values += np.split(value.astype(np.float32), cuts)
    return keys, values


@dataclass
class Scorer:
    """A logistic scorer: probability of the good class is sigmoid(slope * margin + shift)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * BUCKETS, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, text: pa.Array) -> np.ndarray:
        out = np.full(len(text), self.bias)
        for low, high in pieces_of(text):
            data, at = bytes_of(text.slice(low, high - low))
            for bucket, owner in buckets(data, at):
                total = np.bincount(owner, minlength=high - low)
                out[low:high] += SCALE * np.bincount(owner, self.weights[bucket], high - low) / np.maximum(total, 1)
        return out

    def probabilities(self, text: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(text) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(keys: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Fit a scorer to targets of 0 to 1 by full-batch steps with per-weight rates. Rows without features only move the bias."""
    sizes = np.array([len(k) for k in keys])
    flat, value = np.concatenate(keys).astype(np.int64), np.concatenate(values).astype(np.float64)
    used, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(keys)), sizes)
    weight = weight / weight.sum()
    w, b, seen, seen_b = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        error = (sigmoid(np.bincount(owner, w[flat] * value, len(keys)) + b) - target) * weight
        slope = np.bincount(flat, error[owner] * value, len(used)) + decay * w
        seen += slope**2
        seen_b += error.sum() ** 2
        w -= rate * slope / np.sqrt(seen)
        b -= rate * error.sum() / np.sqrt(seen_b)
    out = Scorer(bias=b)
    out.weights[used] = w
    return out


def calibrate(scorer: Scorer, margin: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None) -> Scorer:
    """Platt scaling on rows that training did not see, with smoothed targets; Newton steps on two numbers.

    A row's weight is the number of rows it stands for; weights are scaled to the number of rows that are there."""
    n = len(target)
    if not 0 < target.sum() < n:
        return scorer
    w = np.ones(n) if weight is None else weight * n / weight.sum()
    good = (w * target).sum()
    t = np.where(target > 0.5, (good + 1) / (good + 2), 1 / (n - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        v = w * p * (1 - p)
        g = np.array([(w * (p - t) * margin).sum(), (w * (p - t)).sum()]) + 1e-6 * np.array([a, b])
        h = np.array([[(v * margin**2).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    scorer.slope, scorer.shift = float(max(a, 1e-3)), float(b)
    return scorer
