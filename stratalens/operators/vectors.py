"""Vector search: exact cosine, newest segments, tombstones, and the tag basis."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.scores import cosine
from stratalens.operators.filters import finite_score
from stratalens.operators.ranking import ranked, top_per_group

#: Limits of the tag basis: vectors, condition, explained energy, residual length.
MAX_BASIS, MAX_CONDITION, MIN_ENERGY, MIN_RESIDUAL = 64, 1e6, 1e-6, 1e-4
#: Segments are compacted beyond so many deltas or that share of tombstones.
MAX_DELTAS, MAX_DEAD = 8, 0.20


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """The cosine with one query vector, which travels as a literal."""
    return vectors.withColumn("score", cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))))


def newest_segments(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Of a key that several segments hold, the newest one's row: an aggregate, with partial results before the shuffle."""
    rest = [c for c in vectors.columns if c not in keys and c != "segment"]
    return vectors.groupBy(*keys).agg(F.max("segment").alias("segment"), *(F.max_by(c, "segment").alias(c) for c in rest))


def without_tombstones(vectors: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return vectors.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def selected(vectors: DataFrame, **equal) -> DataFrame:
    """Vectors of a space, memory, revision or generation; what isn't given isn't tested."""
    for name, value in equal.items():
        if value is not None:
            vectors = vectors.where(F.col(name) == value)
    return vectors


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    return scored(vectors, query).orderBy(F.desc("score"), "memory_id").limit(k).select("space_id", "memory_id", "score")


def top_k_per_space(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    return top_per_group(scored(vectors, query).select("space_id", "memory_id", "score"), ["space_id"], [F.desc("score"), F.col("memory_id")], k)


def semantic_channel(vectors: DataFrame, records: DataFrame, query: list[float], in_scope: Column, cap: int, max_results: int, tombstones: DataFrame | None = None) -> DataFrame:
    """Current targets by their best vector. Ranks from 0.

    ``in_scope`` is the predicate on records: only vectors of records that it holds for are searched, so
    ``cap`` never fills up with others'.
    """
    if "segment" in vectors.columns:
        vectors = newest_segments(vectors, ["space_id", "memory_id"])
    if tombstones is not None:
        vectors = without_tombstones(vectors, tombstones, ["space_id", "memory_id"])
    current = records.where(in_scope)
    mine = vectors.join(current.select("space_id", "memory_id").distinct(), ["space_id", "memory_id"], "left_semi")
    best = scored(mine, query).where(finite_score()).orderBy(F.desc("score"), "space_id", "memory_id").limit(cap).select("space_id", "memory_id", "score")
    hits = current.join(F.broadcast(best), ["space_id", "memory_id"])  # cap rows
    return ranked(hits.orderBy(F.desc("score"), "memory_id", "space_id").limit(max_results), [F.desc("score"), F.col("memory_id"), F.col("space_id")])


@dataclass
class Basis:
    """What tag vectors explain of a query, and what is left."""

    projection: np.ndarray
    residual: np.ndarray
    rank: int
    condition: float
    explained: float
    used: bool

    @property
    def searchable(self) -> bool:
        return self.used and float(np.linalg.norm(self.residual)) > MIN_RESIDUAL


def tag_basis(query: list[float], tags: list[list[float]]) -> Basis:
    """Project a query on the span of at most ``MAX_BASIS`` tag vectors, by singular values."""
    q = np.asarray(query, float)
    none = Basis(np.zeros_like(q), q, 0, float("inf"), 0.0, False)
    sound = [t for t in tags[:MAX_BASIS] if len(t) == len(q) and np.isfinite(t).all() and np.any(t)]
    if not sound or not np.isfinite(q).all() or not np.any(q):
        return none
    u, s, _ = np.linalg.svd(np.asarray(sound, float).T, full_matrices=False)
    keep = s > s[0] * max(len(q), len(sound)) * np.finfo(np.float32).eps
    rank, condition = int(keep.sum()), float(s[0] / s[keep][-1])
    projection = u[:, keep] @ (u[:, keep].T @ q)
    explained = float(projection @ projection / (q @ q))
    if condition > MAX_CONDITION or explained < MIN_ENERGY:
        return Basis(np.zeros_like(q), q, rank, condition, explained, False)
    return Basis(projection, q - projection, rank, condition, explained, True)


def needs_compaction(segments: DataFrame, tombstones: int) -> bool:
    facts = segments.agg(F.countDistinct("segment").alias("segments"), F.count(F.lit(1)).alias("rows")).first()
    return facts.segments - 1 > MAX_DELTAS or (facts.rows > 0 and tombstones / facts.rows > MAX_DEAD)
