"""Quality classifier from weak labels.

Eight heuristic labellers, each over a measure of its own, vote good, bad or nothing on every document; they
overlap in the documents they vote on. Bad documents are of several kinds, one for each labeller as its chief
witness; others may see a kind too. Expectation-maximisation over the counts of vote patterns (at most
3 ** labellers of them, counted over all documents) estimates the kinds' shares and how often each labeller
that votes is right on good documents and on each kind, and with these the probability that a document of a
pattern is good. A bounded
sample of documents, about `SAMPLE_DOCS` of each likely class by a hash of the id, trains a hashed linear
scorer on these posterior labels, calibrated to the classes' shares of all documents; it then scores every
document.

Defined results: null text is empty text, on which every labeller abstains, so its posterior is the prior;
equal votes of both kinds are no tie: accuracies decide; with no rows there is no result; if all documents
look alike the posterior alone decides; repeated rows get a row each, with equal scores for equal texts;
other columns are ignored. Very long texts are counted and scored whole, in memory of some 60 bytes for each
of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, pieces_of, prepare
from .linear import Scorer
from .quality_rules import fit_rows
from .textstats import counts

SAMPLE_DOCS = 1500
#: Documents scored at this probability or more are kept.
LEAST_GOOD = 0.5

ABSTAIN, BAD, GOOD = 0, 1, 2


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """One column for each labeller, one row for each text.

    Each has a measure of its own (symbols, capitals, repeated windows, repeated lines, exclamation marks,
    variety of words, length of words, share of ASCII letters), votes bad where it is far off and good where
    it is as in prose, and abstains in between and where a text is too short for it."""
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), c["n_upper"] + c["n_lower"]
    many = c["n_words"] >= 20

    def vote(can: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(can & bad, BAD, np.where(can & good, GOOD, ABSTAIN))

    symbols, upper, repeated, lines = c["n_symbols"] / words, c["n_upper"] / np.maximum(letters, 1), c["n_repeat_words"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1)
    marks, variety, length, plain = c["n_marks"] / words, c["n_distinct"] / words, chars / words, letters / chars
    return np.stack(
        [
            vote(c["n_words"] > 0, symbols >= 0.2, symbols <= 0.05),
            vote(letters >= 20, upper >= 0.4, upper <= 0.2),
            vote(many, repeated >= 0.5, repeated <= 0.25),
            vote(c["n_lines"] >= 5, lines >= 0.4, lines <= 0.1),
            vote(many, marks >= 0.2, marks <= 0.05),
            vote((c["n_words"] >= 50) & (c["n_words"] < 2000), variety <= 0.2, variety >= 0.4),
            vote(many, (length < 2.5) | (length > 14), (length >= 3.5) & (length <= 9)),
            vote(many, plain < 0.6, plain >= 0.8),
        ],
        1,
    ).astype(np.int64)


LABELLERS = 8
PLACES = 3 ** np.arange(LABELLERS)


#: A labeller that votes calls at most this share of good documents bad; and at least this share of those that it is the chief witness of.
MOST_WRONG, LEAST_SEEN = 0.02, 0.5


@dataclass
class LabelModel:
    """shares: of good documents, then of each kind of bad ones; bad: for these, how often each labeller that votes says bad."""

    shares: np.ndarray
    bad: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.shares[0])

    @property
    def right(self) -> np.ndarray:
        """For bad and good documents, how often each labeller that votes is right."""
        return np.stack([self.shares[1:] @ self.bad[1:] / self.shares[1:].sum(), 1 - self.bad[0]])

    def kinds(self, vote: np.ndarray) -> np.ndarray:
        """For rows of votes, the probability of each kind, good first."""
        log = np.log(self.shares) + (vote == BAD) @ np.log(self.bad).T + (vote == GOOD) @ np.log(1 - self.bad).T
        weight = np.exp(log - log.max(1, keepdims=True))
        return weight / weight.sum(1, keepdims=True)

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        return self.kinds(vote)[:, 0]


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 2000, start: tuple[float, float, float] = (0.8, 0.8, 0.01)) -> LabelModel:
    """Expectation-maximisation over patterns and their counts.

    It starts from a share of good documents, from how often a chief witness says bad, and from how often any
    labeller says so on good documents; on other kinds labellers start half-way between."""
    vote = pattern[:, None] // PLACES % 3
    good, seen, wrong = start
    own = np.eye(LABELLERS, dtype=bool)
    shares = np.concatenate(([good], np.full(LABELLERS, (1 - good) / LABELLERS)))
    model = LabelModel(shares, np.concatenate((np.full((1, LABELLERS), wrong), np.where(own, seen, (seen + wrong) / 2))))
    for _ in range(rounds):
        weight = model.kinds(vote) * count[:, None]
        shares = (weight.sum(0) + 1) / (weight.sum() + LABELLERS + 1)
        said_bad, said = weight.T @ (vote == BAD), weight.T @ (vote != ABSTAIN)
        bad = np.clip((said_bad + 1) / (said + 2), 5e-4, 0.98)
        bad[0] = np.minimum(bad[0], MOST_WRONG)
        bad[1:][own] = np.maximum(bad[1:][own], LEAST_SEEN)
        moved = max(np.abs(shares - model.shares).max(), np.abs(bad - model.bad).max())
        model = LabelModel(shares, bad)
        if moved < 1e-7:
            break
    return model


def _patterns(text: pa.Array) -> np.ndarray:
    return votes(counts(*bytes_of(text))) @ PLACES


def fit_labels(docs: DataFrame) -> tuple[LabelModel, dict[int, int]]:
    """The label model over all documents, and the number of documents of each pattern."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**LABELLERS, np.int64)
        for batch in batches:
            text = batch.column(0).fill_null("")
            for low, high in pieces_of(text):
                total += np.bincount(_patterns(text.slice(low, high - low)), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["pattern", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    found = {r["pattern"]: r["n"] for r in rows}
    return estimate(np.array(list(found), np.int64), np.array(list(found.values()), np.int64)), found


def fit_scorer(docs: DataFrame, model: LabelModel, found: dict[int, int], sample_docs: int = SAMPLE_DOCS) -> Scorer | None:
    """Train the hashed linear scorer on posterior labels of a bounded sample."""
    pattern = np.array(list(found), np.int64)
    posterior = model.posterior(pattern[:, None] // PLACES % 3)
    good = sum(n for n, p in zip(found.values(), posterior, strict=True) if p >= 0.5)
    share = [min(1.0, sample_docs / max(1, sum(found.values()) - good)), min(1.0, sample_docs / max(1, good))]
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).fill_null("")
            for low, high in pieces_of(text):
                part = text.slice(low, high - low)
                p = model.posterior(_patterns(part)[:, None] // PLACES % 3)
                taken = batch.column(2).slice(low, high - low).to_numpy() < np.where(p >= 0.5, share[1], share[0])
                weight = 1 / np.where(p >= 0.5, share[1], share[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), part, pa.array(p), pa.array(weight)], names=["doc_id", "text", "target", "weight"]).filter(pa.array(taken))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), chance.alias("chance")).where(F.col("chance") < max(share))
    return fit_rows(rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, target double, weight double"))


def classify(docs: DataFrame) -> DataFrame:
    """For documents (doc_id, text): weak_label (posterior of good), score (of the linear scorer), kept."""
    spark = docs.sparkSession
    model, found = fit_labels(docs)
    shared = spark.sparkContext.broadcast((model, fit_scorer(docs, model, found)))  # a fixed number of weights
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        for batch in batches:
            text = batch.column(1).fill_null("")
            for low, high in pieces_of(text):
                part = text.slice(low, high - low)
                weak = model.posterior(_patterns(part)[:, None] // PLACES % 3)
                score = scorer.probabilities(part) if scorer else weak
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(weak), pa.array(score), pa.array(score >= LEAST_GOOD)], names=["doc_id", "weak_label", "score", "kept"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, weak_label double, score double, kept boolean")
