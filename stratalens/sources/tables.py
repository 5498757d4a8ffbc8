"""The driver's tables as the model's: what each stands for is said at its function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.model import SERVING, close_intervals
from stratalens.functions.text import normalize_tag, tag_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def serving_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as serving records: space = lang, memory = doc_id, generation = doc_id + 1; toxic ones are retired."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            F.col("lang").alias("space_id"),
            F.col("doc_id").alias("memory_id"),
            F.sha2("text", 256).alias("revision_id"),
            "text",
            F.array(F.concat(F.lit("source:"), "source")).alias("entity_refs"),
            F.array("source", F.concat(F.lit("size-"), F.col("n_chars") % 7)).alias("tags"),
            F.array().cast("array<string>").alias("node_ids"),
            F.array().cast("array<string>").alias("relations"),
            F.lit(True).alias("current"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("retired"),
            (F.col("doc_id") % 97 == 0).alias("purged"),
            (F.col("doc_id") + 1).alias("generation"),
            F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 500).alias("valid_until"),
        )
        .to(SERVING)
    )


def turn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a versioned table: memory = conv_id, a revision for each turn, generation = turn + 1."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("memory_id"), "turn", "role", "text", (F.col("turn") + 1).alias("valid_from"))
    return close_intervals(turns, ["memory_id"]).withColumn("revision_id", F.concat_ws(":", "memory_id", "turn"))


def tag_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tagged memories: words of p_name are explicit tags, type and brand generated ones."""
    part = table(spark, sf_dir, "part")
    base = part.select((F.concat(F.lit("S"), F.col("p_size") % 5)).alias("space_id"), F.col("p_partkey").alias("memory_id"), F.array_distinct(F.split("p_name", " ")).alias("explicit"), F.array_distinct(F.array("p_type", "p_brand")).alias("generated"))
    rows = base.select("space_id", "memory_id", F.explode("explicit").alias("raw"), F.lit("explicit").alias("provenance")).unionByName(base.select("space_id", "memory_id", F.explode("generated").alias("raw"), F.lit("generated").alias("provenance")))
    tag = normalize_tag(F.col("raw"))
    return rows.select("space_id", "memory_id", tag.alias("tag"), tag_key(tag).alias("tag_id"), "provenance").where(F.col("tag").isNotNull())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as memberships of segments: space = label, segment = vec_id mod 3."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("L"), "label").alias("space_id"), F.col("vec_id").alias("memory_id"), (F.col("vec_id") % 3).cast("int").alias("segment"), F.col("embedding").alias("vector"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: views are no feedback."""
    return feedback_of(table(spark, sf_dir, "events"))


def feedback_of(events: DataFrame) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "used").when(F.col("event_type") == "click", "correct_for_query").when(F.col("event_type") == "signup", "sufficient").when(F.col("event_type") == "error", "rejected")
    return events.select(
        "event_id",
        F.concat(F.lit("S"), F.col("user_id") % 4).alias("space_id"),
        F.col("user_id").alias("memory_id"),
        outcome.alias("outcome"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("tag"),
    ).where(F.col("outcome").isNotNull())


def place_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, nations and regions as links between targets."""
    cust = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target"), F.lit("located-in").alias("kind"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("source"), F.concat(F.lit("R"), "n_regionkey").alias("target"), F.lit("part-of").alias("kind"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("source"), F.concat(F.lit("C"), "o_custkey").alias("target"), F.lit("references").alias("kind"))
    return cust.unionByName(nation).unionByName(orders)
