"""What feedback teaches: familiarity, affinities, and a bounded prior that only breaks ties.

All sums and maxima commute, so the order of events doesn't matter, and a checkpoint with the events
after it gives what all events give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import scores as S


def weight(outcome: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in S.OUTCOMES.items():
        out = F.when(outcome == name, F.lit(w)).otherwise(out)
    return out


def _sums() -> list[Column]:
    w = weight(F.col("outcome"))
    return [
        F.sum((w > 0).cast("long")).alias("positive_count"),
        F.sum((w < 0).cast("long")).alias("negative_count"),
        F.sum(F.greatest(w, F.lit(0.0))).alias("positive_weight"),
        F.sum(F.greatest(-w, F.lit(0.0))).alias("negative_weight"),
    ]


def familiarity(events: DataFrame) -> DataFrame:
    """By memory: counts, positive weight and the last success; negative outcomes only count."""
    success = F.when(weight(F.col("outcome")) > 0, F.col("micros"))
    return events.groupBy("space_id", "memory_id").agg(*_sums()[:3], F.max(success).alias("last_success"))


def affinity(events: DataFrame, by: str = "tag") -> DataFrame:
    """By memory and tag (or query class): weights and their balance within -1 to 1."""
    rows = events.where(F.col(by).isNotNull()).groupBy("space_id", "memory_id", by).agg(*_sums())
    return rows.withColumn("score", S.affinity(F.col("positive_weight"), F.col("negative_weight")))


def merge_states(checkpoint: DataFrame, tail: DataFrame) -> DataFrame:
    """Familiarity of a prefix and of the rest, as one."""
    return checkpoint.unionByName(tail).groupBy("space_id", "memory_id").agg(*(F.sum(c).alias(c) for c in ("positive_count", "negative_count", "positive_weight")), F.max("last_success").alias("last_success"))


def priors(state: DataFrame, affinities: DataFrame, spaces: list[str], tags: list[str], now: int) -> DataFrame:
    """(space_id, memory_id, accessibility, prior) for a query of these spaces and tags; ``now`` in seconds."""
    known = affinities.where(F.col("tag").isin(tags)).groupBy("space_id", "memory_id").agg(F.collect_list("score").alias("known"))
    target = S.accessibility(F.coalesce("positive_weight", F.lit(0.0)), F.floor(F.col("last_success") / 1_000_000), now)
    both = state.join(known, ["space_id", "memory_id"], "full").where(F.col("space_id").isin(spaces))
    both = both.withColumn("accessibility", S.context_accessibility(target, F.coalesce("known", F.array().cast("array<double>"))))
    return both.select("space_id", "memory_id", "accessibility", (F.col("accessibility") * S.MAX_PRIOR).alias("prior"))


def tie_break(results: DataFrame, prior: DataFrame) -> DataFrame:
    """By relevance, and only among equals by prior."""
    return results.join(prior, ["space_id", "memory_id"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0))).orderBy(F.desc("relevance"), F.desc("prior"), "memory_id", "revision_id")


def new_events(log: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """The batch's events that the log doesn't have; of one key the first."""
    return batch.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def conflicts(log: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """Keys that the batch uses for another content than the log, or for several."""
    content = [c for c in batch.columns if c != key]
    every = log.select(*batch.columns).unionByName(batch).withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    return every.groupBy(key).agg(F.countDistinct("_hash").alias("contents")).where("contents > 1")


def reset(log: DataFrame, space: str | None = None, memory: int | None = None) -> DataFrame:
    """The log without a space's events, or a memory's, or (neither given) without any."""
    gone = F.lit(True)
    if space is not None:
        gone = gone & (F.col("space_id") == space)
    if memory is not None:
        gone = gone & (F.col("memory_id") == memory)
    return log.where(~gone)
