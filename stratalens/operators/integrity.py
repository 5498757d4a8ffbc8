"""Integrity of the versioned tables: each test gives the rows that break it, under a code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.model import overlaps
from stratalens.operators.graph import doubled, jumps
from stratalens.sources.store import corrupt_blobs, settled

def _found(rows: DataFrame, code: str, subject) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), subject.cast("string").alias("subject")).distinct()


def check(spaces: DataFrame, space_states: DataFrame, memories: DataFrame, memory_states: DataFrame, revisions: DataFrame, parents: DataFrame, blobs: DataFrame, generation: int, fast: bool = False) -> DataFrame:
    """(code, subject) of all that is wrong.

    spaces (space_id, created), space_states (space_id, space_key, lifecycle, valid_from, valid_to),
    memories (memory_id, created), memory_states (memory_id, space_id, document_key, revision_id,
    lifecycle, valid_from, valid_to), revisions (revision_id, memory_id, blob, generation), parents
    (revision_id, parent_id), blobs (blob, or blob and content, which is then hashed). ``fast`` looks at current sources only, and not at cycles.
    """
    out: list[DataFrame] = []
    add = lambda rows, code, subject: out.append(_found(rows, code, F.col(subject)))
    for identity, states, key, prefix in ((spaces, space_states, "space_id", "SPACE"), (memories, memory_states, "memory_id", "MEMORY")):
        add(identity.where("created < 0"), "GENERATION_NEGATIVE", key)
        add(identity.where(F.col("created") > generation), "IDENTITY_GENERATION", key)
        add(states.where((F.col("valid_from") > generation) | (F.col("valid_to") > generation)), "STATE_GENERATION", key)
        add(states.where(F.col("valid_to") <= F.col("valid_from")), "STATE_INTERVAL", key)
        add(overlaps(states, [key]), "STATE_OVERLAP", key)
        add(states.join(identity, key, "left_anti"), f"{prefix}_IDENTITY", key)
        add(identity.join(states, key, "left_anti"), f"{prefix}_STATE_MISSING", key)
        facts = states.groupBy(key).agg(F.sum(F.col("valid_to").isNull().cast("int")).alias("open"), F.min("valid_from").alias("first"))
        add(facts.where("open <> 1"), f"{prefix}_CURRENT_STATE", key)
        add(facts.join(identity, key).where(F.col("first") != F.col("created")), f"{prefix}_CREATION_GENERATION", key)
    now = memory_states.where("valid_to is null")
    add(memory_states.join(spaces, "space_id", "left_anti"), "MEMORY_SPACE", "memory_id")
    add(memory_states.join(revisions.select("revision_id"), "revision_id", "left_anti").where(F.col("revision_id").isNotNull()), "FOREIGN_KEY", "revision_id")
    add(space_states.where("valid_to is null").groupBy("space_key").count().where("count > 1"), "SPACE_KEY_DUPLICATE", "space_key")
    add(now.where("document_key is not null").groupBy("space_id", "document_key").count().where("count > 1"), "DOCUMENT_KEY_DUPLICATE", "document_key")
    add(revisions.where((F.col("generation") > generation) | (F.col("generation") < 0)), "REVISION_GENERATION", "revision_id")
    add(revisions.join(memories, "memory_id", "left_anti"), "REVISION_MEMORY", "revision_id")
    add(parents.join(revisions.select(F.col("revision_id").alias("parent_id")), "parent_id", "left_anti"), "REVISION_PARENT_MISSING", "revision_id")
    of = revisions.select("revision_id", F.col("memory_id").alias("own"))
    both = parents.join(of, "revision_id").join(of.select(F.col("revision_id").alias("parent_id"), F.col("own").alias("theirs")), "parent_id")
    add(both.where("own <> theirs"), "REVISION_PARENT_MEMORY", "revision_id")
    head = memory_states.join(revisions.select("revision_id", F.col("memory_id").alias("owner"), "generation"), "revision_id", "left")
    add(head.where("owner is null"), "HEAD_MISSING", "memory_id")
    add(head.where("owner <> memory_id"), "HEAD_OWNERSHIP", "memory_id")
    add(head.where("generation > valid_from"), "HEAD_GENERATION", "memory_id")
    wanted = now.select("revision_id").distinct().join(revisions, "revision_id") if fast else revisions
    add(wanted.join(blobs, "blob", "left_anti"), "SOURCE_BLOB_MISSING", "revision_id")
    if "content" in blobs.columns:
        add(wanted.join(corrupt_blobs(blobs), "blob"), "SOURCE_BLOB_HASH", "revision_id")
    if not fast:
        add(in_cycles(parents), "REVISION_CYCLE", "revision_id")
    return reduce(DataFrame.unionByName, out).distinct()


def in_cycles(parents: DataFrame) -> DataFrame:
    """Revisions that are their own ancestors.

    Walks of 1, 2, 4 … steps: without a cycle none is left after log2 of the longest chain. As many
    steps as there are revisions only fit in, before or behind a cycle; of these the closure tells.
    """
    steps = jumps(parents)
    first, size, length = steps, steps.select("revision_id").distinct().count(), 1
    while length <= size and steps.limit(1).count():
        steps, length = doubled(steps), 2 * length
    left = steps.select("revision_id").distinct().join(steps.select(F.col("up").alias("revision_id")).distinct(), "revision_id")
    paths = settled(first.join(left, "revision_id").join(left.withColumnRenamed("revision_id", "up"), "up").select("revision_id", "up"), "cycles")
    known = paths.count()
    while known:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.up") == F.col("b.revision_id")).select(F.col("a.revision_id").alias("revision_id"), F.col("b.up").alias("up"))
        paths = settled(paths.unionByName(longer).distinct(), "cycles")
        now = paths.count()
        if now == known:
            break
        known = now
    return paths.where("revision_id = up").select("revision_id").distinct()


def dangling(rows: DataFrame, column: str, there: DataFrame, key: str) -> DataFrame:
    """Rows that refer to what isn't there."""
    return rows.where(F.col(column).isNotNull()).join(there.select(F.col(key).alias(column)), column, "left_anti")
