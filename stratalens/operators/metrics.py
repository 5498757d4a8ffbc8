"""Retrieval quality: recall, reciprocal rank, discounted gain, percentiles, and the acceptance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, mrr, ndcg) at k. ``ranked``: (query_id, doc, rank from 0); ``grades``: (query_id, doc, grade > 0)."""
    from pyspark.sql import Window

    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1.0) / F.log2(r + 2.0)
    relevant = grades.where("grade > 0")
    hits = ranked.where(F.col("rank") < k).join(relevant, ["query_id", "doc"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    ideal = relevant.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc")) - 1)
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") < k, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("ideal"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(hits, "query_id", "left").select("query_id", zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(1.0 / (F.col("first") + 1)).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def nearest_rank(c: str, p: float) -> Column:
    """The nearest-rank percentile: a value that occurs."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def accept(baseline: dict[str, float], candidate: dict[str, float], target_recall: float = 0.0, min_gain: float = 0.0, max_slowdown: float = 1.0) -> list[str]:
    """The tests that a candidate fails against a baseline; none: accepted."""
    failed = []
    if candidate["recall"] - baseline["recall"] < target_recall:
        failed.append("recall gain")
    if candidate["ndcg"] - baseline["ndcg"] < min_gain:
        failed.append("ndcg gain")
    if candidate["ndcg"] < baseline["ndcg"]:
        failed.append("ndcg loss")
    if candidate["p95"] > baseline["p95"] * (1 + max_slowdown):
        failed.append("p95")
    if candidate.get("violations", 0) > 0:
        failed.append("constraint violations")
    return failed
