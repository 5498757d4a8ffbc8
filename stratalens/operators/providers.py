"""Providers of embeddings, rerank scores and tags: how they are called, and what they may answer.

A provider is a function from a list of texts to a list of answers. It runs on executors, one Arrow
batch at a time, and is tried again with growing pauses. Answers are validated before they are used.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts, and the first and longest pause in seconds.
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 4, 0.5, 8.0

Provider = Callable[[list[str]], list]


class ProviderError(RuntimeError):
    """No valid answer after all attempts, or one that isn't valid."""


def retried(provider: Provider, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> Provider:
    """The provider with attempts and pauses of 0.5, 1, 2 … at most 8 seconds."""

    def call(texts: list[str]) -> list:
        for n in range(attempts):
            try:
                return provider(texts)
            except Exception as e:  # whatever a provider raises counts as a failed attempt
                if n + 1 == attempts:
                    raise ProviderError(str(e)) from e
                pause(min(LONGEST_PAUSE, FIRST_PAUSE * 2**n))
        raise ProviderError("no attempt was allowed")

    return call


def check_embeddings(texts: list[str], answer: list, dimension: int) -> None:
    """Raise unless there is one finite vector of the dimension for each text."""
    if len(answer) != len(texts):
        raise ProviderError("an answer for each text is needed")
    for v in answer:
        if len(v) != dimension or not all(math.isfinite(x) for x in v):
            raise ProviderError("a vector isn't finite or of another dimension")


def hash_embedding(dimension: int = 64) -> Provider:
    """For tests: a unit vector that follows from the text's hash alone."""

    def one(text: str) -> list[float]:
        raw = hashlib.shake_256(text.encode("utf-8", "surrogatepass")).digest(2 * dimension)
        v = [int.from_bytes(raw[2 * i : 2 * i + 2], "big") / 32767.5 - 1.0 for i in range(dimension)]
        length = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / length for x in v]

    return lambda texts: [one(t) for t in texts]


def embed(df: DataFrame, text_col: str, provider: Provider, dimension: int, attempts: int = ATTEMPTS) -> DataFrame:
    """``df`` and ``vector``: each different text of a batch is asked for once; null texts get null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retried(provider, attempts)
        for texts in parts:
            distinct = sorted({t for t in texts if t is not None})
            answer = call(distinct) if distinct else []
            check_embeddings(distinct, answer, dimension)
            of = dict(zip(distinct, answer))
            yield texts.map(lambda t: of.get(t))

    return df.withColumn("vector", run(F.col(text_col)))


def embed_missing(wanted: DataFrame, payloads: DataFrame, text_col: str, provider: Provider, dimension: int) -> DataFrame:
    """(input_hash, vector) for input hashes that have no payload yet, each once."""
    new = wanted.join(payloads.select("input_hash"), "input_hash", "left_anti").dropDuplicates(["input_hash"])
    return embed(new, text_col, provider, dimension).select("input_hash", "vector")
