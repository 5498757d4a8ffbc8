"""Tags: dictionary, co-occurrence, composite view and readout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.scores import READOUT, edge_signal, edge_weight


def dictionary(memberships: DataFrame) -> DataFrame:
    return memberships.select("tag", "tag_id").distinct()


def membership_counts(memberships: DataFrame) -> DataFrame:
    """Distinct memories of each tag in each space, by provenance."""
    return memberships.groupBy("space_id", "tag").agg(F.countDistinct("memory_id").alias("memories"), F.countDistinct(F.when(F.col("provenance") == "explicit", F.col("memory_id"))).alias("explicit"))


def cooccurrence(memberships: DataFrame) -> DataFrame:
    """Edges (space_id, left, right, explicit, generated, weight): memories with both tags explicit, or both generated.

    A memory's tags are gathered once and paired inside the row (a memory has few tags), so the pairs
    are counted before anything is shuffled a second time.
    """
    own = memberships.groupBy("space_id", "memory_id", "provenance").agg(F.array_sort(F.collect_set(F.struct("tag_id", "tag"))).alias("tags"))
    pairs = own.select("space_id", "provenance", F.explode(F.flatten(F.transform("tags", lambda a: F.transform(F.filter("tags", lambda b: a["tag_id"] < b["tag_id"]), lambda b: F.struct(a.alias("l"), b.alias("r")))))).alias("p"))
    n = lambda kind: F.sum((F.col("provenance") == kind).cast("long"))
    edges = pairs.groupBy("space_id", F.col("p.l.tag").alias("left"), F.col("p.r.tag").alias("right"), F.col("p.l.tag_id").alias("left_id"), F.col("p.r.tag_id").alias("right_id")).agg(n("explicit").alias("explicit"), n("generated").alias("generated"))
    return edges.withColumn("weight", edge_weight(F.col("explicit").cast("double"), F.col("generated").cast("double")))


def composite(edges: DataFrame, spaces: list[str]) -> DataFrame:
    """Edges summed over the scope's spaces, with their signal."""
    total = edges.where(F.col("space_id").isin(spaces)).groupBy("left", "right", "left_id", "right_id").agg(F.sum("explicit").alias("explicit"), F.sum("generated").alias("generated"))
    weighted = total.withColumn("weight", edge_weight(F.col("explicit").cast("double"), F.col("generated").cast("double")))
    return weighted.withColumn("signal", edge_signal(F.col("weight")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, src_id, dst_id, signal), each edge in both directions."""
    one = edges.select(F.col("left").alias("src"), F.col("right").alias("dst"), F.col("left_id").alias("src_id"), F.col("right_id").alias("dst_id"), "signal")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "signal"))


def merge_edges(*views: DataFrame) -> DataFrame:
    """Edges of several views: the larger static and adaptive weight of each."""
    every = views[0]
    for v in views[1:]:
        every = every.unionByName(v)
    ends = every.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "static_weight", "adaptive_weight")
    return ends.groupBy("left", "right").agg(F.max("static_weight").alias("static_weight"), F.max("adaptive_weight").alias("adaptive_weight"))


def readout(memberships: DataFrame, seeds: list[str], spaces: list[str], limit: int) -> DataFrame:
    """Memories of the seed tags: explicit ones first. The limit comes before any test of the memory."""
    score = F.when(F.col("provenance") == "explicit", READOUT["explicit"]).otherwise(READOUT["generated"])
    hits = memberships.where(F.col("tag").isin(seeds) & F.col("space_id").isin(spaces)).withColumn("score", score)
    return hits.orderBy(F.desc("score"), "space_id", "memory_id", "tag_id").limit(limit).select("space_id", "memory_id", "tag", "tag_id", "provenance", "score")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and mean weight of each tag."""
    ends = edges.select(F.col("left").alias("tag"), "weight").unionByName(edges.select(F.col("right").alias("tag"), "weight"))
    return ends.groupBy("tag").agg(F.count(F.lit(1)).alias("degree"), F.avg("weight").alias("mean_weight"))


def generated_tags(candidates: DataFrame, limit: int = 8) -> DataFrame:
    """(space_id, memory_id, tag, tag_id, score) of proposals (value, score, position): normalised, scores within 0 to 1, first of each tag, at most ``limit``."""
    from stratalens.functions.text import normalize_tag, tag_key

    tag = normalize_tag(F.col("value"))
    sound = candidates.withColumn("tag", tag).where(F.col("tag").isNotNull() & F.col("score").between(0.0, 1.0) & (F.col("position") < limit))
    first = sound.groupBy("space_id", "memory_id", "tag").agg(F.min("position").alias("position"), F.min_by("score", "position").alias("score"))
    return first.withColumn("tag_id", tag_key(F.col("tag")))


def seeds(explicit: list[str], basis: list[tuple[str, str, float]], semantic_active: bool, limit: int) -> dict[str, float]:
    """Seed weights by tag: explicit ones, then the selected basis candidates (provenance, score, tag), the larger weight staying."""
    from stratalens.functions.scores import SEED_WEIGHTS

    out = {t: SEED_WEIGHTS["explicit"] for t in explicit}
    order = list(SEED_WEIGHTS)
    usable = [c for c in basis if semantic_active or c[1] != "semantic"]
    for tag, provenance, _ in sorted(usable, key=lambda c: (order.index(c[1]), -c[2], c[0]))[: min(limit, 64)]:
        out[tag] = max(out.get(tag, 0.0), SEED_WEIGHTS[provenance])
    return out
