"""From ranked channels to one row for each target: reciprocal ranks, bonuses, consolidation, assessment.

A pool is a long table: channel, space_id, memory_id, revision_id, rank (from 0), and for each family
of evidence the number of its items; strongest (of propagation) and resolutions (of semantic hits).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import scores as S
from stratalens.model import TARGET

COUNTS = [f"n_{family}" for family in S.FAMILIES]
POOL = ["channel", *TARGET, "rank", *COUNTS, "strongest", "resolutions"]


def pool_rows(channel: str, hits: DataFrame, **evidence: Column) -> DataFrame:
    """A channel's hits (target columns and rank) as rows of a pool; ``evidence`` gives its counts, strongest and resolutions."""
    empty = {c: F.lit(0) for c in COUNTS} | {"strongest": F.lit(None).cast("double"), "resolutions": F.array().cast("array<string>")}
    given = empty | evidence
    return hits.select(F.lit(channel).alias("channel"), *TARGET, F.col("rank").cast("long").alias("rank"), *(given[c].cast("long").alias(c) for c in COUNTS), given["strongest"].alias("strongest"), given["resolutions"].alias("resolutions"))


def fuse(pool: DataFrame, spaces: list[str] | None = None, limit: int | None = None, k: float = S.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion with bonuses.

    A channel counts once for a target, at its best rank; the others are counted as suppressed. The
    scope and ``limit`` apply before the bonuses, which then reorder what is left.
    """
    once = pool.groupBy("channel", *TARGET).agg(
        F.min("rank").alias("rank"),
        F.count(F.lit(1)).alias("units"),
        *(F.max(c).alias(c) for c in COUNTS),
        F.max("strongest").alias("strongest"),
        F.flatten(F.collect_list("resolutions")).alias("resolutions"),
    )
    # ranks become places among the channel's targets; a channel is a short list by its limit
    from pyspark.sql import Window

    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy("rank", *TARGET)) - 1)
    merged = placed.groupBy(*TARGET).agg(
        F.sum(S.rrf(F.col("place"), k)).alias("rrf"),
        F.sum(F.col("units") - 1).alias("suppressed"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        *(F.sum(c).alias(c) for c in COUNTS),
        F.max("strongest").alias("strongest"),
        F.flatten(F.collect_list("resolutions")).alias("resolutions"),
    )
    if spaces is not None:
        merged = merged.where(F.col("space_id").isin(spaces))
    if limit is not None:
        merged = merged.orderBy(F.desc("rrf"), "memory_id", "space_id", "revision_id").limit(limit)
    support = F.when(F.col("strongest").isNotNull(), S.support_bonus(F.col("n_propagation"), F.col("strongest"), F.lit(0.0))).otherwise(0.0)
    unique = F.size(F.array_distinct("resolutions"))
    structure = F.when(F.size("resolutions") >= 2, S.structure_bonus(unique / 3.0, F.lit(0), unique > 1)).otherwise(0.0)
    return merged.withColumns({"support": support, "structure": structure, "relation": S.relation_bonus(F.col("n_relations")), "families": families()}).withColumn("score", F.col("rrf") + F.col("support") + F.col("structure") + F.col("relation"))


def families() -> Column:
    """How many families of evidence a row has."""
    return reduce(lambda a, b: a + b, ((F.col(c) > 0).cast("int") for c in COUNTS))


def evidence_strength() -> Column:
    return F.col("n_exact") + 0.5 * (F.col("n_lexical") + F.col("n_semantic")) + 0.25 * (F.col("n_tags") + F.col("n_relations") + F.col("n_history"))


def consolidate(candidates: DataFrame, max_results: int) -> DataFrame:
    """One row for each target of candidates (target, score, kinds: array of evidence families).

    The best candidate is primary; each further one, by score, adds its score to the support only if
    it brings a family that none before it had.
    """
    rows = candidates.groupBy(*TARGET).agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "kinds")))).alias("all"))
    start = F.struct(F.lit(0.0).alias("support"), F.col("all")[0]["kinds"].alias("seen"))
    step = lambda s, x: F.when(
        F.size(F.array_except(x["kinds"], s["seen"])) > 0,
        F.struct((s["support"] + F.greatest(x["score"], F.lit(0.0))).alias("support"), F.array_union(s["seen"], x["kinds"]).alias("seen")),
    ).otherwise(s)
    folded = rows.withColumn("fold", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), start, step))
    score = F.col("all")[0]["score"] + 0.5 * (1.0 - F.exp(-F.col("fold.support")))
    kinds = F.array_distinct(F.flatten(F.transform("all", lambda x: x["kinds"])))
    n = F.size(F.array_distinct(F.transform(kinds, lambda k: F.when(k.startswith("semantic"), F.lit("semantic")).otherwise(k))))
    done = folded.select(*TARGET, score.alias("score"), n.alias("families"))
    return presented(done).orderBy(F.desc("relevance"), "memory_id", "revision_id", "space_id").limit(max_results)


def presented(df: DataFrame) -> DataFrame:
    """A score and a number of families as relevance, confidence, accessibility and effort."""
    return df.withColumns({"relevance": S.relevance(F.col("score")), "confidence": S.confidence(F.col("families")), "accessibility": F.lit(0.5), "effort": S.effort(F.col("families"))})


def trim_evidence(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Keep the first ``most`` items across the arrays, in their order."""
    left = F.lit(most)
    for c in columns:
        kept = F.slice(c, 1, F.greatest(left, F.lit(0)))
        left = left - F.size(c)
        df = df.withColumn(c, kept)
    return df


def assess(results: DataFrame) -> DataFrame:
    """One row: how many results, the best relevance, and means; zeros where there is none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return results.agg(F.count(F.lit(1)).alias("result_count"), F.max("relevance").alias("top_relevance"), mean("confidence").alias("mean_confidence"), mean("accessibility").alias("mean_accessibility"), mean("effort").alias("mean_effort"), mean(F.col("families") / 7.0).alias("channel_coverage"))
