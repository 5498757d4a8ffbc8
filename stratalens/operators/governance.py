"""Policies, purge, transfer between stores, and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import fingerprint

#: From the most restrictive on; a provider is local or external.
POLICIES = ("deny", "local-only", "external-allowed")


def ordinal(policy: Column) -> Column:
    out = F.lit(0)  # what isn't known is denied
    for n, name in enumerate(POLICIES):
        out = F.when(policy == name, n).otherwise(out)
    return out


def most_restrictive(states: DataFrame, by: list[str], policy: str = "policy") -> DataFrame:
    """The policy of a scope: that of its most restrictive space."""
    low = F.min(ordinal(F.col(policy)))
    return states.groupBy(*by).agg(F.element_at(F.array(*(F.lit(p) for p in POLICIES)), low + 1).alias("policy"))


def allows(policy: str, external: bool) -> bool:
    return POLICIES.index(policy) >= (2 if external else 1)


def purge(records: DataFrame, gone: DataFrame, key: str = "memory_id") -> DataFrame:
    """The records without the purged memories; their sources are freed unless others use them."""
    return records.join(gone.select(key).distinct(), key, "left_anti")


def unreferenced(blobs: DataFrame, *users: DataFrame, key: str = "blob") -> DataFrame:
    """Blobs that no user refers to."""
    used = users[0].select(key)
    for u in users[1:]:
        used = used.unionByName(u.select(key))
    return blobs.join(used, key, "left_anti")


def mapping(records: DataFrame, first_id: int) -> DataFrame:
    """(memory_id, new_id): ids of an import, all set before any document is rewritten. New ids follow the rank of the old ones, counted in parts so that no task sees all."""
    from pyspark.sql import Window

    parts = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = records.select("memory_id").distinct().repartitionByRange(parts, "memory_id").withColumn("part", F.spark_partition_id())
    nth = ids.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("memory_id")))
    sizes = ids.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return nth.join(F.broadcast(offsets), "part").select("memory_id", (F.lit(first_id - 1) + F.col("before") + F.col("nth")).alias("new_id"))


def import_records(records: DataFrame, ids: DataFrame, space: str) -> DataFrame:
    """Records under their new ids in one new space, references rewritten where they are known."""
    refs = records.select("memory_id", F.posexplode_outer("relations").alias("at", "relation"))
    refs = refs.withColumn("to", F.when(F.col("relation").startswith("memory-ref:"), F.substring("relation", 12, 1000).cast("long")))
    known = ids.select(F.col("memory_id").alias("to"), F.col("new_id").alias("new_to"))
    written = refs.join(known, "to", "left").withColumn("relation", F.when(F.col("new_to").isNotNull(), F.concat(F.lit("memory-ref:"), "new_to")).otherwise(F.col("relation")))
    lists = written.where("relation is not null").groupBy("memory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "relation"))), lambda x: x["relation"]).alias("relations"))
    moved = records.drop("relations").join(lists, "memory_id", "left").join(ids, "memory_id")
    return moved.select(*(F.col("new_id").alias("memory_id") if c == "memory_id" else F.lit(space).alias("space_id") if c == "space_id" else F.coalesce("relations", F.array().cast("array<string>")).alias("relations") if c == "relations" else F.col(c) for c in records.columns))


def unresolved_references(records: DataFrame, there: DataFrame) -> DataFrame:
    """(memory_id, target) of references to memories that aren't there."""
    refs = records.select("memory_id", F.explode("relations").alias("relation")).where(F.col("relation").startswith("memory-ref:"))
    refs = refs.select("memory_id", F.substring("relation", 12, 1000).cast("long").alias("target"))
    return refs.join(there.select(F.col("memory_id").alias("target")), "target", "left_anti")


def package_fingerprint(records: DataFrame) -> DataFrame:
    """A fingerprint of a package that doesn't depend on the order of its rows."""
    one = F.xxhash64(fingerprint("package-v1", F.col("memory_id").cast("string"), F.col("revision_id")))
    return records.agg(F.count(F.lit(1)).alias("records"), F.bit_xor(one).alias("digest"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("memory_id").count().where("count > 1").select("memory_id")


def discover_entities(observations: DataFrame, surface: str, spaces: list[str]) -> DataFrame:
    """Entities seen under a surface text, in allowed spaces only: the filter comes before all else."""
    return observations.where((F.col("surface") == surface) & F.col("space_id").isin(spaces)).select("entity_ref").distinct()
