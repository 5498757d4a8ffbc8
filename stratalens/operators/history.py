"""Versioned states: reads at a generation, history listings, and changes as new intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import fingerprint
from stratalens.model import as_of



class Conflict(ValueError):
    """A change doesn't fit the state that it was made for."""


def heads(history: DataFrame, at: int) -> DataFrame:
    """The state of each memory at a generation."""
    return as_of(history, at)


def listing(history: DataFrame, at: int, limit: int, order: str = "valid_from") -> DataFrame:
    """All revisions up to a generation, newest first."""
    return history.where(F.col(order) <= at).orderBy(F.desc(order), "memory_id", "revision_id").limit(limit)


def resolve_logical(history: DataFrame, at: int) -> DataFrame:
    """For each memory its newest revision at or before a generation: an aggregate, no sort."""
    return history.where(F.col("valid_from") <= at).groupBy("memory_id").agg(F.max("valid_from").alias("generation"), F.max_by("revision_id", "valid_from").alias("revision_id"))


def exists_active(history: DataFrame, spaces: list[str]) -> bool:
    return history.where(F.col("space_id").isin(spaces) & F.col("valid_to").isNull() & (F.col("lifecycle") == "active")).limit(1).count() > 0


def revision_id(memory: Column, parents: Column, blob: Column, intent: Column) -> Column:
    """A revision's name follows from its content: memory, sorted parents, source and intent."""
    return fingerprint("revision-v1", memory.cast("string"), F.array_join(F.array_sort(parents), ","), blob, intent)


def change(history: DataFrame, changes: DataFrame, generation: int, keys: list[str], columns: list[str]) -> DataFrame:
    """Apply changes (keys and the columns that change) at a generation: the current row of each key ends there and a new one begins.

    A key without a current row is refused by the caller (``missing``). Unchanged keys keep their rows.
    """
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = history.join(new.withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.col("_hit").isNotNull() & F.col("valid_to").isNull()
    ended = joined.select(*(F.when(hit, F.lit(generation)).otherwise(F.col("valid_to")).alias("valid_to") if c == "valid_to" else F.col(c) for c in history.columns))
    begun = joined.where(hit).select(*(F.lit(generation).cast("long").alias(c) if c == "valid_from" else F.lit(None).cast("long").alias(c) if c == "valid_to" else F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in history.columns))
    return ended.unionByName(begun)


def missing(history: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes whose key has no current row."""
    return changes.join(history.where("valid_to is null"), keys, "left_anti")


def move(history, memory: int, space: str, generation: int) -> DataFrame:
    return change(history, _one(history, memory, space_id=space), generation, ["memory_id"], ["space_id"])


def rename_key(history, memory: int, key: str, generation: int) -> DataFrame:
    return change(history, _one(history, memory, document_key=key), generation, ["memory_id"], ["document_key"])


def retire(history, memory: int, generation: int) -> DataFrame:
    return change(history, _one(history, memory, lifecycle="retired"), generation, ["memory_id"], ["lifecycle"])


def restore(history, memory: int, generation: int) -> DataFrame:
    return change(history, _one(history, memory, lifecycle="active"), generation, ["memory_id"], ["lifecycle"])


def change_space(states: DataFrame, space: str, generation: int, **values: str) -> DataFrame:
    """A space's new key, lifecycle or policies, as a new interval; keys in use by another space are refused."""
    if "space_key" in values and states.where(F.col("valid_to").isNull() & (F.col("space_key") == values["space_key"]) & (F.col("space_id") != space)).limit(1).count():
        raise Conflict("the key is in use")
    schema = "space_id string, " + ", ".join(f"{k} string" for k in values)
    new = states.sparkSession.createDataFrame([(space, *values.values())], schema)
    if missing(states, new, ["space_id"]).limit(1).count():
        raise Conflict("there is no such space")
    return change(states, new, generation, ["space_id"], list(values))


def create_space(states: DataFrame, space: str, key: str, generation: int, **values: str) -> DataFrame:
    """A new space, active from a generation on; its key must be free."""
    if states.where(F.col("valid_to").isNull() & ((F.col("space_key") == key) | (F.col("space_id") == space))).limit(1).count():
        raise Conflict("the space or its key is there")
    full = {"space_id": space, "space_key": key, "lifecycle": "active", "valid_from": generation, "valid_to": None} | values
    return states.unionByName(states.sparkSession.createDataFrame([tuple(full.get(c) for c in states.columns)], states.schema))


def revise(history: DataFrame, memory: int, expected_head: str, revision: str, generation: int) -> DataFrame:
    """A new head, if the present one is the one expected and the memory is active."""
    head = history.where((F.col("memory_id") == memory) & F.col("valid_to").isNull()).select("revision_id", "lifecycle").first()
    if head is None or head.revision_id != expected_head:
        raise Conflict("the head isn't the one expected")
    if head.lifecycle != "active":
        raise Conflict("the memory isn't active")
    return change(history, _one(history, memory, revision_id=revision), generation, ["memory_id"], ["revision_id"])


def create(history: DataFrame, row: dict, generation: int) -> DataFrame:
    """A new memory; its key must be free in its space. The same row again changes nothing."""
    spark = history.sparkSession
    now = history.where(F.col("valid_to").isNull() & (F.col("space_id") == row["space_id"]) & (F.col("document_key") == row["document_key"]))
    held = now.first()
    if held is not None:
        if all(held[k] == v for k, v in row.items()):
            return history
        raise Conflict("the key is in use")
    full = {**row, "valid_from": generation, "valid_to": None}
    return history.unionByName(spark.createDataFrame([tuple(full[c] for c in history.columns)], history.schema))


def merge_parents(parents: list[str], edges: DataFrame | None, memory_of: dict[str, int]) -> list[str]:
    """The sorted parents of a merge: at least two different ones, of one memory."""
    distinct = sorted(set(parents))
    if len(distinct) < 2 or len(distinct) != len(parents):
        raise Conflict("a merge has at least two different parents")
    if len({memory_of.get(p) for p in distinct}) != 1:
        raise Conflict("the parents are of different memories")
    return distinct


def merge(history: DataFrame, parents: DataFrame, revisions: DataFrame, memory: int, merged: list[str], revision: str, generation: int) -> tuple[DataFrame, DataFrame]:
    """(states, parent edges) with a merge revision as the memory's new head.

    ``merged`` are its parents: at least two different ones, of that memory, the present head among them.
    """
    of = {r.revision_id: r.memory_id for r in revisions.where(F.col("revision_id").isin(merged)).select("revision_id", "memory_id").collect()}  # one each
    sound = merge_parents(merged, parents, of)
    if of[sound[0]] != memory:
        raise Conflict("the parents are of another memory")
    head = history.where((F.col("memory_id") == memory) & F.col("valid_to").isNull()).select("revision_id").first()
    if head is None or head.revision_id not in sound:
        raise Conflict("the head isn't among the parents")
    edges = history.sparkSession.createDataFrame([(revision, p) for p in sound], "revision_id string, parent_id string")
    return revise(history, memory, head.revision_id, revision, generation), parents.unionByName(edges)


def _one(history: DataFrame, memory: int, **values) -> DataFrame:
    schema = "memory_id long, " + ", ".join(f"{k} string" for k in values)
    return history.sparkSession.createDataFrame([(memory, *values.values())], schema)


def apply_batch(history: DataFrame, operations: list[tuple], generation: int) -> DataFrame:
    """Ordered operations (name, arguments) in one generation."""
    named = {"move": move, "rename": rename_key, "retire": retire, "restore": restore, "revise": revise, "create": create}
    for name, *arguments in operations:
        history = named[name](history, *arguments, generation)
    return history
