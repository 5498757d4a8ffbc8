"""The data model: schemas, and visibility by logical generation.

Every table that changes over time has rows with a half-open interval of generations. Scores are
doubles throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERVING = T.StructType(
    [
        T.StructField("space_id", T.StringType()),
        T.StructField("memory_id", T.LongType()),
        T.StructField("revision_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("entity_refs", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("node_ids", T.ArrayType(T.StringType())),
        T.StructField("relations", T.ArrayType(T.StringType())),
        T.StructField("current", T.BooleanType()),
        T.StructField("retired", T.BooleanType()),
        T.StructField("purged", T.BooleanType()),
        T.StructField("generation", T.LongType()),
        T.StructField("valid_until", T.LongType()),
    ]
)
TARGET = ["space_id", "memory_id", "revision_id"]
#: Kinds of elements in a document, in their fixed order.
KINDS = ("MemoryMeta", "Section", "Entity", "Tag", "State", "Event", "Relation", "MemoryRef", "Source", "Quote", "Extension")


def visible_at(generation: Column, valid_until: Column, at: int | Column) -> Column:
    """Whether a row is seen at generation ``at``: from its own on, and before it ends."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (generation <= at) & (valid_until.isNull() | (at < valid_until))


def as_of(history: DataFrame, at: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The rows of a versioned table that hold at generation ``at``."""
    return history.where(visible_at(F.col(start), F.col(end), at))


def close_intervals(events: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Turn a table of states with their first generation into intervals: each ends where the key's next begins."""
    return events.withColumn(end, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def overlaps(history: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows that begin before an earlier row of their key has ended."""
    before = Window.partitionBy(*keys).orderBy(start, F.coalesce(F.col(end), F.lit(2**62))).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("_reach", F.max(F.coalesce(F.col(end), F.lit(2**62))).over(before)).where(F.col("_reach") > F.col(start)).drop("_reach")


def latest(history: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """For each key, the values at the highest ``order``; an aggregate, so no group is sorted."""
    return history.groupBy(*keys).agg(F.max(order).alias(order), *(F.max_by(v, order).alias(v) for v in values))
