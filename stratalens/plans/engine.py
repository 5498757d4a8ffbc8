"""The query path end to end: plan, channels, fusion, consolidation, reranking, prior, assessment."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import normalize_tag
from stratalens.model import TARGET
from stratalens.operators import adaptive, fusion, graph, lexical, rerank, tags, vectors
from stratalens.operators.filters import exact_match, history_match, semantic_scope
from stratalens.operators.providers import Provider, ProviderError
from stratalens.operators.ranking import ranked
from stratalens.plans.query import Plan, Query, Snapshot, plan
from stratalens.sources.store import held, settled


@dataclass
class Store:
    """The tables that a query reads. ``records`` must be there; what else is missing, its channels don't run."""

    records: DataFrame
    snapshot: Snapshot
    vectors: DataFrame | None = None
    tombstones: DataFrame | None = None
    memberships: DataFrame | None = None
    edges: DataFrame | None = None
    links: DataFrame | None = None
    feedback: DataFrame | None = None
    index: lexical.LexicalIndex | None = None


@dataclass
class Answer:
    results: DataFrame
    assessment: DataFrame
    plan: Plan


def exact_channel(records: DataFrame, query: Query, generation: int) -> DataFrame:
    """The first records in scan order, then ranked by memory."""
    if query.history == "current":
        match = exact_match(list(query.spaces), generation, list(query.cue_memories), list(query.memories), list(query.entities), list(query.tags))
    else:
        match = history_match(list(query.spaces), generation, list(query.text), list(query.memories), list(query.entities), list(query.tags))
    first = records.where(match).orderBy("space_id", "memory_id", "revision_id").limit(query.max_results)
    return ranked(first, [F.col("memory_id"), F.col("space_id"), F.col("revision_id")])


def _pool(channel: str, hits: DataFrame, **evidence) -> DataFrame:
    """A channel's rows, at most as many as its limits allow; computed once, as fusion and relations both read them."""
    return held(fusion.pool_rows(channel, hits, **evidence))


def _channels(store: Store, query: Query, p: Plan) -> list[DataFrame]:
    """The pools of the plan's channels. Those that don't need one another run at the same time."""
    with ThreadPoolExecutor(max_workers=4) as threads:
        return _run_channels(store, query, p, threads)


def _run_channels(store: Store, query: Query, p: Plan, threads: ThreadPoolExecutor) -> list[DataFrame]:
    spaces, records = list(query.spaces), store.records
    running: list[Future] = []
    begin = lambda make: running.append(threads.submit(inheritable_thread_target(records.sparkSession)(make)))
    hard = {"memories": list(query.memories), "entities": list(query.entities), "tags": list(query.tags)}
    if "exact" in p.channels:
        begin(lambda: _pool("exact", exact_channel(records, query, p.generation), n_exact=F.lit(2), n_tags=F.size("tags"), n_relations=F.size("relations")))
    if "lexical" in p.channels:
        begin(lambda: _pool("lexical", lexical.lexical_channel(records, list(query.text), spaces, p.profile.lexical, query.max_results, store.index, **hard), n_lexical=F.lit(1)))
    match = semantic_scope(spaces, p.generation, **hard)
    basis = None
    tag_vectors: list[tuple[str, str, float]] = []
    if store.vectors is not None and query.query_vector is not None and "semantic" in p.used:
        search = lambda q, cap: vectors.semantic_channel(store.vectors, records, list(q), match, min(cap, query.max_candidates), query.max_results, store.tombstones)
        one = F.array(F.lit("document"))
        if "semantic-direct" in p.channels:
            begin(lambda: _pool("semantic-direct", search(query.query_vector, p.profile.semantic), n_semantic=F.lit(1), resolutions=one))
        if store.memberships is not None:
            own = store.memberships.join(store.vectors.select("space_id", "memory_id", "vector"), ["space_id", "memory_id"]).where(F.col("space_id").isin(spaces))
            rank = F.when(F.col("provenance") == "explicit", 0.95).otherwise(0.55)
            best = own.withColumn("weight", rank).groupBy("tag", "tag_id").agg(F.min(F.struct(-F.col("weight"), "space_id", "memory_id", "vector", "provenance")).alias("b"))
            chosen = best.orderBy(F.col("b.col1"), "tag_id").limit(min(p.profile.basis, vectors.MAX_BASIS)).collect()  # 64 at most
            basis = vectors.tag_basis(list(query.query_vector), [r.b.vector for r in chosen])
            tag_vectors = [(r.tag, "exact-support" if r.b.provenance == "explicit" else "generated", -r.b[0]) for r in chosen]
        if "semantic-residual" in p.channels and basis is not None and basis.searchable:
            begin(lambda: _pool("semantic-residual", search(basis.residual.tolist(), p.profile.residual), n_semantic=F.lit(1), resolutions=one))
    if "tag-readout" in p.channels and store.memberships is not None and store.edges is not None:
        spark = records.sparkSession
        explicit = [r.t for r in spark.createDataFrame([(t,) for t in query.cue_tags], "t string").select(normalize_tag(F.col("t")).alias("t")).distinct().collect() if r.t]
        weights = tags.seeds(sorted(explicit), tag_vectors if basis is not None and basis.used else [], "semantic" in p.used, p.profile.basis)
        if weights:
            current = records.where(exact_match(spaces, p.generation, [], **hard)).select(*TARGET)
            named = lambda hits: ranked(hits.join(current, ["space_id", "memory_id"]).limit(p.profile.readout), [F.desc("score"), F.col("space_id"), F.col("memory_id"), F.col("tag")])
            begin(lambda: _pool("tag-readout", named(tags.readout(store.memberships, sorted(weights), spaces, p.profile.readout)), n_tags=F.lit(1)))
            view = settled(tags.both_ways(tags.composite(store.edges, spaces)), "edges")

            def spread(channel: str, scores: DataFrame) -> DataFrame:
                return _pool(channel, named(graph.propagation_readout(store.memberships, held(scores), spaces, p.profile.readout)), n_propagation=F.lit(1), strongest=F.col("score"))

            begin(lambda: spread("activation", graph.bounded_activation(view, sorted(weights.items()), p.profile.tags, p.profile.edges, p.profile.hops)))
            if "diffusion" in p.channels:
                nodes = lambda: held(graph.reachable(view, sorted(weights), p.profile.diffusion_nodes, p.profile.hops))
                begin(lambda: spread("diffusion", graph.diffusion(view, weights, nodes=nodes())))
    out = [f.result() for f in running]
    if "relation" in p.channels and store.links is not None and out:
        starts = reduce(DataFrame.unionByName, (x.select(F.col("memory_id").alias("target")) for x in out)).distinct()
        found = graph.expand_relations(store.links, starts, p.profile.relation_hops, p.profile.relation_added).where(F.size("kinds") > 0)
        kept = records.where(exact_match(spaces, p.generation, [], **hard)).join(found.withColumnRenamed("target", "memory_id"), "memory_id")
        rows = kept.orderBy("space_id", "memory_id", "revision_id").limit(query.max_candidates)
        out.append(_pool("relation", ranked(rows, [F.col(c) for c in TARGET]), n_relations=F.size("kinds")))
    return out


def run(store: Store, query: Query, now: int = 0, denied: frozenset[str] = frozenset(), reranker: Provider | None = None) -> Answer:
    """Answer a query. ``now`` (seconds) is for the prior's recency only.

    By default as served: ``valid_at``, ``lifecycle`` and ``min_relevance`` choose channels or are
    checked, and filter nothing; with ``strict`` the last one filters. ``reranker`` scores texts within
    0 to 1; without one, or if it fails, reranking degrades where it is preferred and is an error where
    it is required.
    """
    p = plan(query, store.snapshot, denied | (frozenset() if reranker else frozenset({"reranking"})))
    pools = _channels(store, query, p)
    if not pools:
        pools = [fusion.pool_rows("exact", ranked(store.records.limit(0), [F.col("memory_id")]))]
    fused = fusion.fuse(reduce(DataFrame.unionByName, pools), list(query.spaces), query.max_candidates)
    shown = fusion.presented(fused)
    if query.strict and query.min_relevance is not None:
        shown = shown.where(F.col("relevance") >= query.min_relevance)
    wide = max(query.max_results, p.profile.rerank) if p.rerank else query.max_results
    top = F.broadcast(shown.orderBy(F.desc("relevance"), "memory_id", "revision_id", "space_id").limit(wide))  # wide rows
    # by space and memory first: a revision's hash is then computed for these rows alone
    near = store.records.join(top.select("space_id", "memory_id").distinct(), ["space_id", "memory_id"], "left_semi")
    results = top.join(near.select(*TARGET, "text"), TARGET)
    if p.rerank:
        results = held(results)
        try:
            results = rerank.apply(results, rerank.ask(rerank.batch(results, query.quality), reranker)).limit(query.max_results)
        except (ProviderError, ValueError):
            if "reranking" in query.required:
                raise
            p = replace(p, rerank=False, degraded=(*p.degraded, "reranking"))
            results = results.orderBy(F.desc("relevance"), "memory_id", "revision_id").limit(query.max_results)
    elif p.adaptive and store.feedback is not None:
        prior = adaptive.priors(adaptive.familiarity(store.feedback), adaptive.affinity(store.feedback), list(query.spaces), list(query.cue_tags), now)
        results = adaptive.tie_break(results, prior)
    else:
        results = results.orderBy(F.desc("relevance"), "memory_id", "revision_id")
    return Answer(results, fusion.assess(results), p)
