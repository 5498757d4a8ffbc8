"""Propagation over the tag graph, relation links, and reachability in the revision graph.

Hops and iterations are bounded by the query profile, so each algorithm is a fixed number of joins.
Where a result depends on the order in which edges are visited (budgets), one task walks the bounded
scope graph; everything else is joins.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.scores import CONVERGED, EPSILON, FLOW, HOP_DECAY, ITERATIONS, RESTART
from stratalens.sources.store import settled

#: Edges of a scope graph at most, each with both directions; larger ones are refused.
MAX_EDGES = 100_000
#: Rounds of diffusion after which the scores are written.
CUT = 4


def _seed_frame(spark: SparkSession, seeds: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(seeds.items()), "tag string, score double")


def activation(edges: DataFrame, seeds: dict[str, float], hops: int) -> DataFrame:
    """(tag, score, hops): for each tag the best path from a seed; a hop multiplies by the edge's signal and by one half.

    ``edges``: both directions (src, dst, signal). Without budgets: the maximum over all paths of at
    most ``hops`` edges whose every prefix stays over the threshold.
    """
    best = _seed_frame(edges.sparkSession, seeds).withColumn("hops", F.lit(0))
    frontier = best
    for n in range(1, hops + 1):
        step = edges.join(frontier.select(F.col("tag").alias("src"), F.col("score").alias("from_score")), "src")
        reached = step.select(F.col("dst").alias("tag"), (F.col("from_score") * F.col("signal") * HOP_DECAY).alias("score")).where(F.col("score") > EPSILON)
        frontier = reached.groupBy("tag").agg(F.max("score").alias("score")).withColumn("hops", F.lit(n))
        both = best.unionByName(frontier)
        best = both.groupBy("tag").agg(F.max("score").alias("score"), F.min_by("hops", F.struct(-F.col("score"), "hops")).alias("hops"))
    return best


def walk(edges: list[tuple[str, str, float]], seeds: list[tuple[str, float]], max_tags: int, max_edges: int, max_hops: int) -> tuple[dict[str, tuple[float, int]], int, bool]:
    """Best-path activation in visiting order, with budgets: ({tag: (score, hops)}, edge visits, truncated). ``edges``: (src, dst, signal) in the order of visiting."""
    near: dict[str, list[tuple[str, float]]] = {}
    for src, dst, signal in edges:
        near.setdefault(src, []).append((dst, signal))
    active: dict[str, tuple[float, int]] = {}
    queue: deque[tuple[str, float, int]] = deque()
    visits, truncated = 0, False
    for tag, weight in seeds:
        if tag not in active and len(active) >= max_tags:
            truncated = True
            break
        if tag not in active or weight > active[tag][0] + EPSILON:
            active[tag] = (weight, active.get(tag, (0.0, 0))[1])
            queue.append((tag, weight, 0))
    while queue:
        tag, score, hops = queue.popleft()
        if hops >= max_hops:
            continue
        for dst, signal in near.get(tag, ()):
            if visits >= max_edges:
                return active, visits, True
            visits += 1
            passed = score * signal * HOP_DECAY
            if passed <= EPSILON:
                continue
            if dst not in active and len(active) >= max_tags:
                truncated = True
            elif dst not in active or passed > active[dst][0] + EPSILON:
                active[dst] = (passed, hops + 1)
                queue.append((dst, passed, hops + 1))
    return active, visits, truncated or visits >= max_edges


def bounded_activation(edges: DataFrame, seeds: list[tuple[str, float]], max_tags: int, max_edges: int, max_hops: int) -> DataFrame:
    """``walk`` over a scope graph (src, dst, dst_id, signal), which has ``MAX_EDGES`` edges at most, in both directions: (tag, score, hops, visits, truncated)."""
    scope = edges.select("src", "dst", "dst_id", "signal")
    if scope.limit(2 * MAX_EDGES + 1).count() > 2 * MAX_EDGES:
        raise ValueError(f"a scope graph has {MAX_EDGES} edges at most")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.itertuples(index=False)]
        rows.sort(key=lambda r: (r.src, r.dst_id))
        active, visits, truncated = walk([(r.src, r.dst, r.signal) for r in rows], seeds, max_tags, max_edges, max_hops)
        yield pd.DataFrame([(t, s, h, visits, truncated) for t, (s, h) in active.items()], columns=["tag", "score", "hops", "visits", "truncated"])

    return scope.coalesce(1).mapInPandas(run, "tag string, score double, hops int, visits long, truncated boolean")


def reachable(edges: DataFrame, seeds: list[str], max_nodes: int, rounds: int) -> DataFrame:
    """Tags within ``rounds`` hops of the seeds, nearest first, at most ``max_nodes``: (tag, hops)."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in sorted(set(seeds))], "tag string, hops int")
    for n in range(1, rounds + 1):
        new = edges.join(seen.select(F.col("tag").alias("src")), "src").select(F.col("dst").alias("tag"), F.lit(n).alias("hops"))
        seen = seen.unionByName(new).groupBy("tag").agg(F.min("hops").alias("hops"))
    return seen.orderBy("hops", "tag").limit(max_nodes)


def diffusion(edges: DataFrame, seeds: dict[str, float], iterations: int = ITERATIONS, nodes: DataFrame | None = None) -> DataFrame:
    """(tag, score) of personalised restart: each round 0.35 of the seeds' share, and 0.65 of each tag's score dealt to its neighbours by signal.

    Edges to tags outside ``nodes`` still count among those that a tag deals to, so mass can leak. Every
    ``CUT`` rounds the scores are written, and the work ends once they change by less than the threshold.
    """
    spark, total = edges.sparkSession, sum(seeds.values())
    share = _seed_frame(spark, {t: w / total for t, w in seeds.items()} if total else seeds)
    deals = edges.where(F.col("signal") > 0).groupBy("src").agg(F.sum("signal").alias("dealt"))
    part = edges.where(F.col("signal") > 0).join(deals, "src").select("src", "dst", (F.col("signal") / F.col("dealt")).alias("part"))
    if nodes is not None:
        part = part.join(nodes.select(F.col("tag").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("tag").alias("src")), "src", "left_semi")
    part = settled(part, "parts")
    restart = share.select("tag", (F.col("score") * RESTART).alias("score"))
    scores = share
    for n in range(1, iterations + 1):
        before = scores
        flow = part.join(scores.select(F.col("tag").alias("src"), "score"), "src").select(F.col("dst").alias("tag"), (F.col("score") * F.col("part") * FLOW).alias("score"))
        scores = restart.unionByName(flow).groupBy("tag").agg(F.sum("score").alias("score"))
        if n % CUT == 0 and n < iterations:
            scores = settled(scores, "diffusion")
            both = scores.join(before.withColumnRenamed("score", "was"), "tag", "full")
            if (both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0) <= CONVERGED:
                break
    return scores.where(F.col("score") > 0)


def diffuse(edges: list[tuple[str, str, float]], seeds: dict[str, float], max_nodes: int, max_edges: int) -> tuple[dict[str, float], int, bool]:
    """Diffusion on a small graph with its budgets and its stop: ({tag: score}, iterations, converged)."""
    near: dict[str, list[tuple[str, float]]] = {}
    for src, dst, signal in edges:
        near.setdefault(src, []).append((dst, signal))
    nodes, queue = dict.fromkeys(seeds), deque(seeds)
    while queue and len(nodes) < max_nodes:
        for dst, _ in near.get(queue.popleft(), ()):
            if dst not in nodes and len(nodes) < max_nodes:
                nodes[dst] = None
                queue.append(dst)
    order, total = sorted(nodes), sum(seeds.values()) or 1.0
    share = {t: seeds.get(t, 0.0) / total for t in order}
    scores, visits = dict(share), 0
    for n in range(1, ITERATIONS + 1):
        after = {t: RESTART * s for t, s in share.items()}
        for src in order:
            out = near.get(src, ())
            dealt = sum(s for _, s in out if s > 0)
            for dst, signal in out if dealt > 0 else ():
                if visits >= max_edges:
                    break
                visits += 1
                if dst in after and signal > 0:
                    after[dst] += FLOW * scores[src] * signal / dealt
        change = sum(abs(after[t] - scores[t]) for t in order)
        scores = after
        if change <= CONVERGED or visits >= max_edges:
            break
    return {t: s for t, s in scores.items() if s > 0}, n, change <= CONVERGED


def propagation_readout(memberships: DataFrame, active: DataFrame, spaces: list[str], limit: int) -> DataFrame:
    """Memories of the active tags in readout order; their score is the tag's times the readout's."""
    from stratalens.functions.scores import READOUT

    score = F.when(F.col("provenance") == "explicit", READOUT["explicit"]).otherwise(READOUT["generated"])
    hits = memberships.where(F.col("space_id").isin(spaces)).join(active.select("tag", F.col("score").alias("tag_score")), "tag")
    return hits.withColumn("read", score).orderBy(F.desc("read"), "space_id", "memory_id", "tag_id").limit(limit).select("space_id", "memory_id", "tag", (F.col("tag_score") * F.col("read")).alias("score"))


def relation_links(records: DataFrame) -> DataFrame:
    """Links (source, target, kind): a record to itself for each of its kinds, and to the first record of each memory that it refers to (``memory-ref:<id>``)."""
    kinds = records.select(F.col("memory_id").alias("source"), F.explode("relations").alias("kind"))
    own = kinds.where(~F.col("kind").startswith("memory-ref:")).select("source", F.col("source").alias("target"), "kind")
    wanted = kinds.where(F.col("kind").startswith("memory-ref:")).select("source", F.substring("kind", 12, 1000).cast("long").alias("target"))
    there = records.select(F.col("memory_id").alias("target")).distinct()
    return own.unionByName(wanted.join(there, "target", "left_semi").select("source", "target", F.lit("references").alias("kind")))


def expand_relations(links: DataFrame, starts: DataFrame, hops: int, max_added: int | None = None) -> DataFrame:
    """(target, hops, kinds): what links lead to from ``starts`` (target), within ``hops``; of new ones at most ``max_added``, nearest and smallest first."""
    seen = starts.select("target").distinct().withColumns({"hops": F.lit(0), "kinds": F.array().cast("array<string>")})
    for n in range(1, hops + 1):
        front = seen.where(F.col("hops") == n - 1).select(F.col("target").alias("source"))
        new = links.join(front, "source").groupBy("target").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).withColumn("hops", F.lit(n))
        seen = seen.unionByName(new).groupBy("target").agg(F.min("hops").alias("hops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    if max_added is None:
        return seen
    added = seen.where("hops > 0").orderBy("hops", "target").limit(max_added)
    return seen.where("hops = 0").unionByName(added)


def jumps(parents: DataFrame) -> DataFrame:
    """The relation itself: (revision_id, up), one step each."""
    return settled(parents.where(F.col("revision_id").isNotNull() & F.col("parent_id").isNotNull()).select("revision_id", F.col("parent_id").alias("up")).distinct(), "jumps")


def doubled(steps: DataFrame) -> DataFrame:
    """The relation of twice as many steps."""
    further = steps.select(F.col("revision_id").alias("up"), F.col("up").alias("next"))
    return settled(steps.join(further, "up").select("revision_id", F.col("next").alias("up")).distinct(), "jumps")


def ancestors(parents: DataFrame, revision: str) -> DataFrame:
    """All revisions that a revision comes from, with their distance; ``parents``: (revision_id, parent_id), of its memory.

    What is known up to distance 2^k, and 2^k steps on from there, gives all up to 2^(k+1): so the
    rounds grow with the logarithm of the depth, and however many paths lead to a revision it is one row.
    """
    spark, step, steps = parents.sparkSession, 1, jumps(parents)
    known, size = spark.createDataFrame([(revision, 0)], "revision_id string, depth long"), 1
    while True:
        further = known.join(steps, "revision_id").select(F.col("up").alias("revision_id"), (F.col("depth") + step).alias("depth"))
        known = settled(known.unionByName(further).groupBy("revision_id").agg(F.min("depth").alias("depth")), "ancestors")
        if (now := known.count()) == size:
            return known.where("depth > 0")
        size, step, steps = now, 2 * step, doubled(steps)
