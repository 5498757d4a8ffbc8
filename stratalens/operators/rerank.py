"""Reranking: the batch that a provider sees, tests of its answer, and the new order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import without_marked_lines
from stratalens.operators.providers import Provider, ProviderError, retried

BATCH = {"fast": 16, "balanced": 32, "thorough": 64}


def handle():
    return F.concat_ws(":", "space_id", "memory_id", "revision_id")


def batch(results: DataFrame, quality: str = "balanced") -> DataFrame:
    """(handle, text, relevance): the most relevant ones, their text without marked lines."""
    rows = results.select(handle().alias("handle"), without_marked_lines(F.col("text")).alias("text"), "relevance")
    return rows.orderBy(F.desc("relevance"), "handle").limit(BATCH[quality])


def check(sent: list[str], answer: list[tuple[str, float]]) -> None:
    """Raise unless the answer scores each handle that was sent, once, within 0 to 1."""
    names = [h for h, _ in answer]
    if len(names) != len(sent) or set(names) != set(sent):
        raise ValueError("the answer's handles aren't those sent")
    if not all(s == s and 0.0 <= s <= 1.0 for _, s in answer):
        raise ValueError("a score isn't within 0 to 1")


def ask(sent: DataFrame, provider: Provider) -> DataFrame:
    """(handle, rerank_score) of a batch (at most 64 rows) by a provider of scores, which is tried again, and its answer tested."""
    rows = sent.select("handle", "text").collect()
    answer = retried(provider)([r.text for r in rows]) if rows else []
    if len(answer) != len(rows):
        raise ProviderError("a score for each text is needed")
    scores = [(r.handle, float(s)) for r, s in zip(rows, answer)]
    check([r.handle for r in rows], scores)
    return sent.sparkSession.createDataFrame(scores, "handle string, rerank_score double")


def apply(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored results first, by score; then the others as they were. ``scores``: (handle, rerank_score), one batch."""
    joined = results.withColumn("handle", handle()).join(F.broadcast(scores), "handle", "left")
    return joined.orderBy(F.col("rerank_score").isNull(), F.desc("rerank_score"), F.desc("relevance"), "memory_id").drop("handle")


def hash_scores(sent: DataFrame) -> DataFrame:
    """A provider for tests: the score is a hash of the handle."""
    return sent.select("handle", (F.conv(F.substring(F.sha2("handle", 256), 1, 6), 16, 10).cast("double") / 16777215.0).alias("rerank_score"))
