"""What changed between two versions of documents, and what must be rebuilt for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that a node's coming or going touches, besides its lifecycle. Fixed values, as the two tables after it.
KIND_CATEGORIES = {
    "Entity": ["EntityBinding", "EntitySurface"], "Tag": ["ExplicitTag"], "Relation": ["Relation"], "MemoryRef": ["MemoryRef"], "Source": ["SourceMetadata"], "Quote": ["SourceMetadata"],
    "Extension": ["Extension"], "Section": ["Hierarchy"], "MemoryMeta": ["Hierarchy"], "State": ["Temporal"], "Event": ["Temporal"],
}
ROOTS = {
    "VisibleText": ["Lexical", "LocalEmbedding", "ContextEmbedding"], "Hierarchy": ["Structural"], "EntityBinding": ["Structural", "EntityObservations", "ContextEmbedding"],
    "EntitySurface": ["EntityObservations", "Lexical", "LocalEmbedding", "ContextEmbedding"], "ExplicitTag": ["ExplicitTags"], "Temporal": ["Temporal"], "Relation": ["Relations"],
    "MemoryRef": ["Structural"], "SourceMetadata": ["Structural"], "Extension": ["Structural"], "SemanticNodeLifecycle": ["Structural"],
}
DEPENDS = {
    "Structural": ["Ir"], "Temporal": ["Ir"], "Relations": ["Ir"], "Lexical": ["Ir"], "EntityObservations": ["Ir", "Structural"], "ExplicitTags": ["Ir", "Structural"], "LocalEmbedding": ["Ir"],
    "ContextEmbedding": ["Ir", "Structural"], "GeneratedTags": ["LocalEmbedding", "ContextEmbedding"], "TagGraph": ["ExplicitTags", "GeneratedTags"],
    "RerankView": ["Structural", "Temporal", "Relations", "EntityObservations", "ExplicitTags", "Lexical", "LocalEmbedding", "ContextEmbedding", "GeneratedTags", "TagGraph"],
}
_DATES = ("occurredAt", "observedAt", "validFrom", "validTo")


def _lifecycle(kind: Column) -> Column:
    out = F.array(F.lit("SemanticNodeLifecycle"))
    for name, more in KIND_CATEGORIES.items():
        out = F.when(kind == name, F.array(F.lit("SemanticNodeLifecycle"), *(F.lit(m) for m in more))).otherwise(out)
    return out


def _changed(name: str) -> Column:
    return ~F.col("o.attributes")[name].eqNullSafe(F.col("n.attributes")[name])


def _plain(side: str) -> Column:
    """The attributes without dates, as something that can be compared."""
    entries = F.filter(F.array_sort(F.map_entries(F.col(f"{side}.attributes"))), lambda e: ~e["key"].isin(*_DATES))
    return F.to_json(entries)


def _attribute_category() -> Column:
    kind, one = F.col("n.kind"), lambda x: F.array(F.lit(x))
    return (
        F.when(kind == "Entity", F.when(_changed("ref") | _changed("about"), one("EntityBinding")).otherwise(one("EntitySurface")))
        .when(kind == "Tag", one("ExplicitTag"))
        .when(kind == "Relation", one("Relation"))
        .when(kind == "MemoryRef", one("MemoryRef"))
        .when(kind == "Source", one("SourceMetadata"))
        .when(kind == "Quote", F.when(_changed("speaker") | _changed("source"), one("SourceMetadata")).otherwise(one("VisibleText")))
        .when(kind == "Extension", one("Extension"))
        .when(kind.isin("State", "Event"), F.when(_changed("about"), one("EntityBinding")).otherwise(one("Hierarchy")))
        .otherwise(one("Hierarchy"))
    )


def semantic_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, node_id, category) between two tables (key, ir); node_id is null for nodes without one, which are compared as multisets."""
    nodes = lambda df: df.select(key, F.explode("ir.nodes").alias("x"))
    o, n = (nodes(df).select(key, F.col("x.id").alias("id"), F.col("x").alias(side)) for df, side in ((old, "o"), (new, "n")))
    both = o.where("id is not null").join(n.where("id is not null"), [key, "id"], "full")
    none = F.array().cast("array<string>")
    text = F.when(F.col("o.text") == F.col("n.text"), none).when(F.col("o.kind") == "Extension", F.array(F.lit("Extension"))).when(F.col("o.kind") == "Entity", F.array(F.lit("VisibleText"), F.lit("EntitySurface"))).otherwise(F.array(F.lit("VisibleText")))
    dates = F.lit(False)
    for name in _DATES:
        dates = dates | _changed(name)
    same_kind = F.concat(text, F.when(dates, F.array(F.lit("Temporal"))).otherwise(none), F.when(_plain("o") != _plain("n"), _attribute_category()).otherwise(none))
    categories = F.when(F.col("o").isNull(), _lifecycle(F.col("n.kind"))).when(F.col("n").isNull(), _lifecycle(F.col("o.kind"))).when(F.col("o.kind") != F.col("n.kind"), F.array(F.lit("SemanticNodeLifecycle"))).otherwise(same_kind)
    named = both.select(key, F.col("id").alias("node_id"), F.explode(categories).alias("category"))
    bare = lambda df, sign: df.where("id is null").select(key, F.col("o" if sign > 0 else "n").alias("x")).select(key, F.col("x.kind").alias("kind"), F.sha2(F.to_json(F.struct("x.kind", F.array_sort(F.map_entries("x.attributes")).alias("a"), "x.text")), 256).alias("h"), F.lit(sign).alias("sign"))
    lost = bare(o, 1).unionByName(bare(n, -1)).groupBy(key, "kind", "h").agg(F.sum("sign").alias("left")).where(F.col("left") != 0)
    unnamed = lost.select(key, F.lit(None).cast("string").alias("node_id"), F.explode(_lifecycle(F.col("kind"))).alias("category"))
    return named.unionByName(unnamed).distinct()


def closure(roots: set[str]) -> set[str]:
    """Projections that depend on any of these, and these."""
    out = set(roots)
    while more := {p for p, needs in DEPENDS.items() if p not in out and out & set(needs)}:
        out |= more
    return out


def rebuilds(diff: DataFrame, key: str) -> DataFrame:
    """(key, projection) to rebuild; any change rebuilds the intermediate form. The table of 11 categories travels as a literal map."""
    plan = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(p) for p in x)) for c, roots in ROOTS.items() for x in (c, sorted(closure(set(roots)) | {"Ir"}))))
    return diff.select(key, F.explode(plan[F.col("category")]).alias("projection")).distinct()
