"""Scores and bonuses as columns. The constants are fixed values of the ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60.0
HOP_DECAY, EPSILON = 0.5, 1e-6
RESTART, FLOW, CONVERGED, ITERATIONS = 0.35, 0.65, 1e-5, 8
SATURATION, RECENCY_SECONDS, MAX_PRIOR = 4.0, 2_592_000.0, 0.1
#: Weights of tag seeds by where they come from.
SEED_WEIGHTS = {"explicit": 1.00, "exact-support": 0.95, "semantic": 0.70, "generated": 0.55, "inherited": 0.40}
READOUT = {"explicit": 0.95, "generated": 0.55}
#: Weight of feedback outcomes; outcomes under zero are negative.
OUTCOMES = {"used": 1.0, "correct_for_query": 1.0, "preferred": 1.0, "sufficient": 0.5, "rejected": -1.0, "incorrect_for_query": -1.0, "insufficient": -1.0}
FAMILIES = ("exact", "lexical", "semantic", "tags", "propagation", "relations", "history")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rrf(rank: Column, k: float = RRF_K) -> Column:
    """``rank`` counts from 0."""
    return F.lit(1.0) / (F.lit(k) + rank)


def support_bonus(seeds: Column, strongest: Column, provenance: Column) -> Column:
    return clamp(0.07 * clamp(F.log1p(seeds.cast("double")) / math.log(5.0)) + 0.03 * clamp(strongest) + 0.02 * clamp(provenance), 0.0, 0.12)


def structure_bonus(diversity: Column, hops: Column, unique: Column) -> Column:
    return clamp(0.03 * clamp(diversity) + 0.03 / (1.0 + hops) + 0.02 * unique.cast("int"), 0.0, 0.08)


def relation_bonus(n: Column) -> Column:
    return F.least(0.025 * n, F.lit(0.05))


def relevance(score: Column) -> Column:
    return score / (1.0 + F.greatest(score, F.lit(0.0)))


def confidence(families: Column) -> Column:
    return F.least(families / 3.0, F.lit(1.0))


def effort(families: Column) -> Column:
    return 1.0 / (1.0 + families)


def effort_from_cost(searches: Column, candidates: Column, edges: Column, relations: Column, barriers: Column) -> Column:
    return clamp(searches / 4.0 + candidates / 256.0 + edges / 1024.0 + relations / 64.0 + barriers / 2.0)


def edge_weight(explicit: Column, generated: Column) -> Column:
    return explicit + 0.5 * generated


def edge_signal(weight: Column) -> Column:
    return clamp(weight / (1.0 + weight))


def strength(positive: Column) -> Column:
    return 1.0 - F.exp(-positive / SATURATION)


def accessibility(positive: Column, last_success: Column, now: int) -> Column:
    """Falls with the seconds since the last success; none without one."""
    age = F.greatest(F.lit(now) - last_success, F.lit(0))
    return F.when(last_success.isNull(), 0.0).otherwise(strength(positive) * F.exp(-age / RECENCY_SECONDS))


def affinity(positive: Column, negative: Column) -> Column:
    total = positive + negative
    return F.when(total == 0, 0.0).otherwise((positive - negative) / total)


def context_accessibility(target: Column, affinities: Column) -> Column:
    """``affinities``: those the query's tags and class have, without nulls."""
    n = F.size(affinities)
    mean = F.when(n == 0, 0.0).otherwise(F.aggregate(affinities, F.lit(0.0), lambda s, x: s + (x + 1.0) / 2.0) / n)
    return clamp(0.75 * target + 0.25 * mean)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero or lengths differ."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)
