"""Who is meant, and which memory belongs to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the most trusted on.
SOURCES = ("conversation", "directory", "observation")


def resolve(candidates: DataFrame) -> DataFrame:
    """(surface, source, entities, status) of candidates (surface, entity_ref, source): those of the most trusted source that knows the surface.

    ``resolved`` with one entity, ``ambiguous`` with several or if it was only observed.
    """
    rank = F.lit(len(SOURCES))
    for n, name in enumerate(SOURCES):
        rank = F.when(F.col("source") == name, n).otherwise(rank)
    by = candidates.withColumn("trust", rank).groupBy("surface", "trust", "source").agg(F.array_sort(F.collect_set("entity_ref")).alias("entities"))
    best = by.groupBy("surface").agg(F.min_by("source", "trust").alias("source"), F.min_by("entities", "trust").alias("entities"))
    status = F.when((F.size("entities") == 1) & (F.col("source") != "observation"), "resolved").otherwise("ambiguous")
    return best.withColumn("status", status)


def discover_owner(records: DataFrame, spaces: list[str], wanted: DataFrame) -> DataFrame:
    """(request, memories, status) for requests (request, entities): memories whose entities hold all that are asked for.

    ``none``, ``existing`` (one memory) or ``ambiguous``.
    """
    asked = wanted.withColumn("entity", F.explode("entities")).select("request", "entity", F.size(F.array_distinct("entities")).alias("n")).distinct()
    own = records.where(F.col("space_id").isin(spaces)).select("memory_id", F.explode("entity_refs").alias("entity")).distinct()
    hits = asked.join(own, "entity").groupBy("request", "memory_id", "n").agg(F.count(F.lit(1)).alias("found")).where("found = n")
    counted = hits.groupBy("request").agg(F.count(F.lit(1)).alias("memories"))
    n = F.coalesce(F.col("memories"), F.lit(0))
    return wanted.select("request").join(counted, "request", "left").select("request", n.alias("memories"), F.when(n == 0, "none").when(n == 1, "existing").otherwise("ambiguous").alias("status"))


#: The tools of an agent, by permission.
TOOLS = {
    "discover": ("discover_entities", "resolve_identity", "discover_owner"),
    "read": ("query", "read_document"),
    "write": ("create_document", "revise_document"),
    "feedback": ("submit_feedback",),
    "lifecycle": ("move_document", "retire_document", "purge_document"),
}


def permitted(tool: str, granted: set[str]) -> bool:
    """Nothing is allowed that hasn't been granted."""
    return any(tool in tools and permission in granted for permission, tools in TOOLS.items())
