"""Embeddings of sequences by an external model, once for each distinct sequence that the cache lacks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import cache_misses

#: A function from a list of sequences to a list of vectors.
Model = Callable[[list[str]], list[list[float]]]
#: Makes a model from the folder or file of its artefacts (None where it has none).
Loader = Callable[[str | None], Model]

#: Letters that a model gets at once, padding counted, unless one sequence has more.
BATCH_LETTERS = 16_384

_MODELS: dict[str, Model] = {}


def loaded(name: str, load: Loader, artefacts: str | None) -> Model:
    """The worker's model of a name, loaded by the first batch that asks for it; workers live on over tasks."""
    if name not in _MODELS:
        _MODELS[name] = load(SparkFiles.get(artefacts) if artefacts else None)
    return _MODELS[name]


def findable(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def in_batches(model: Model, seqs: list[str], most: int = BATCH_LETTERS) -> list[list[float]]:
    """The vectors of sequences, in their order. The model gets sequences of like length together, so that little is padded."""
    order = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
    out: list[list[float]] = [[]] * len(seqs)
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * len(seqs[order[high]]) <= most:
            high += 1
        for k, vector in zip(order[low:high], model([seqs[k] for k in order[low:high]]), strict=True):
            out[k] = vector
        low = high
    return out


def embed(df: DataFrame, cache: DataFrame, load: Loader, seq: str = "seq", name: str = "model", artefacts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(seq, embedding) of all distinct sequences, and of those computed now, which a caller may append to the cache.

    artefacts: a file or folder that the driver can read; Spark brings it to every executor once. A worker loads
    the model of a name once, however many batches and tasks it runs."""
    held = None
    findable(df.sparkSession)
    if artefacts:
        df.sparkSession.sparkContext.addFile(artefacts, recursive=os.path.isdir(artefacts))
        held = os.path.basename(artefacts.rstrip("/"))

    @F.pandas_udf("array<float>")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load, held)
        for batch in batches:
            yield pd.Series(in_batches(model, batch.tolist()), dtype=object)

    new = cache_misses(df, cache, seq).select(seq, infer(F.col(seq)).alias("embedding"))
    known = cache.join(df.select(seq).distinct(), seq, "left_semi").select(seq, "embedding")
    return known.unionByName(new), new
