"""Columns derived from documents' intermediate form, by higher-order functions on the node array: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import deictic_words, fingerprint, normalize_tag, without_headings

def _nodes() -> Column:
    return F.col("ir.nodes")



def _of(*kinds: str) -> Column:
    return F.filter(_nodes(), lambda n: n["kind"].isin(*kinds))


def lexical_text() -> Column:
    """The hierarchy's text and that of all nodes but tags."""
    return F.concat_ws("\n", F.nullif(F.col("ir.hierarchy"), F.lit("")), F.nullif(_node_text(), F.lit("")))


def _node_text() -> Column:
    return F.array_join(F.filter(F.transform(F.filter(_nodes(), lambda n: n["kind"] != "Tag"), lambda n: n["text"]), lambda t: F.length(t) > 0), "\n")


def context_text() -> Column:
    return lexical_text()


def local_text() -> Column:
    """As the lexical text, without headings."""
    return F.concat_ws("\n", F.nullif(without_headings(F.col("ir.hierarchy")), F.lit("")), F.nullif(_node_text(), F.lit("")))


def serving(df: DataFrame) -> DataFrame:
    """``df`` with text, entity_refs, tags, node_ids and relations of a serving record; documents with errors are left out."""
    attribute = lambda kinds, name: F.filter(F.transform(_of(*kinds), lambda n: n["attributes"][name]), lambda v: v.isNotNull())
    refs = F.transform(F.filter(F.transform(_of("MemoryRef"), lambda n: F.coalesce(n["attributes"]["ref"], n["attributes"]["memory"], n["attributes"]["target"])), lambda v: v.isNotNull()), lambda v: F.concat(F.lit("memory-ref:"), v))
    kinds = F.transform(_of("Relation"), lambda n: F.coalesce(n["attributes"]["kind"], F.lit("association")))
    return df.where("ir.error is null").withColumns(
        {
            "text": lexical_text(),
            "entity_refs": F.array_distinct(F.concat(attribute(["Entity"], "ref"), F.filter(F.transform(_nodes(), lambda n: n["attributes"]["about"]), lambda v: v.isNotNull()))),
            "tags": F.array_distinct(attribute(["Tag"], "value")),
            "node_ids": F.filter(F.transform(_nodes(), lambda n: n["id"]), lambda v: v.isNotNull()),
            "relations": F.array_distinct(F.concat(kinds, refs)),
        }
    )


def _parent(n: Column) -> Column:
    """The nearest identified node around a node."""
    around = F.filter(_nodes(), lambda p: p["id"].isNotNull() & (p["start"] < n["start"]) & (p["end"] >= n["end"]))
    return F.array_max(F.transform(around, lambda p: F.struct(p["start"].alias("start"), p["id"].alias("id"))))["id"]


def structure(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, node_id, parent_id)."""
    rows = df.select(key, F.explode(F.transform(_nodes(), lambda n: F.struct(n["kind"].alias("kind"), n["id"].alias("node_id"), _parent(n).alias("parent_id")))).alias("n"))
    return rows.select(key, "n.*")


def temporal(df: DataFrame, key: str) -> DataFrame:
    """Nodes with any of the four dates."""
    rows = df.select(key, F.explode(_nodes()).alias("n"))
    dates = {name: F.col("n.attributes")[raw] for name, raw in (("occurred_at", "occurredAt"), ("observed_at", "observedAt"), ("valid_from", "validFrom"), ("valid_to", "validTo"))}
    return rows.select(key, F.col("n.id").alias("node_id"), *(c.alias(n) for n, c in dates.items())).where(F.coalesce("occurred_at", "observed_at", "valid_from", "valid_to").isNotNull())


def relations(df: DataFrame, key: str) -> DataFrame:
    rows = df.select(key, F.explode(_of("Relation")).alias("n"))
    a = F.col("n.attributes")
    return rows.select(key, F.col("n.id").alias("node_id"), F.substring(a["from"], 2, 300).alias("from_id"), F.substring(a["to"], 2, 300).alias("to_id"), F.coalesce(a["kind"], F.lit("association")).alias("kind"))


def entities(df: DataFrame, key: str) -> DataFrame:
    rows = df.select(key, F.explode(_of("Entity")).alias("n"))
    return rows.select(key, F.col("n.attributes")["ref"].alias("entity_ref"), F.col("n.text").alias("surface"), F.col("n.id").alias("node_id"))


def explicit_tags(df: DataFrame, key: str) -> DataFrame:
    rows = df.select(key, F.explode(F.transform(_of("Tag"), lambda n: F.struct(n["attributes"]["value"].alias("value"), _parent(n).alias("scope_id")))).alias("t"))
    return rows.select(key, "t.value", normalize_tag(F.col("t.value")).alias("tag"), "t.scope_id", F.lit("explicit").alias("provenance"))


def input_hash(kind: str, version: int, signature: str, text: Column) -> Column:
    return fingerprint("projection-input-v1", F.lit(kind), F.lit(str(version)), F.lit(signature), text)


def embedding_key(source: Column, provider: str, model: str, task: str, dimension: int, normalised: bool, version: int) -> Column:
    return fingerprint("embedding-v1", source, *(F.lit(str(x)) for x in (provider, model, task, dimension, normalised, version)))


def lint(df: DataFrame, key: str) -> DataFrame:
    """(key, node_id, words): nodes whose text points at the conversation, outside quotes and sources."""
    quoted = _of("Quote", "Source")
    rows = df.select(key, quoted.alias("quoted"), F.explode(_of("Section", "Entity", "State", "Event")).alias("n"))
    outside = ~F.exists("quoted", lambda q: (q["start"] < F.col("n.end")) & (q["end"] > F.col("n.start")))
    words = deictic_words(F.col("n.text"))
    return rows.where(outside & (F.size(words) > 0)).select(key, F.col("n.id").alias("node_id"), words.alias("words"))
