import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import scores as S
from stratalens.operators import adaptive, fusion, graph, metrics, rerank, tags, vectors
from stratalens.plans.engine import Store, run
from stratalens.plans.query import Query, Snapshot


def both(edges):
    return sorted(edges + [(b, a, s) for a, b, s in edges])


def signal(w):
    return w / (1 + w)


BRANCH = both([("first", "second", signal(1.0)), ("first", "third", signal(0.5)), ("second", "fourth", signal(0.25))])


def test_branching_graph():
    scores, rounds, _ = graph.diffuse(BRANCH, {"first": 1.0}, 256, 4096)
    assert rounds <= 8 and all(s >= 0 for s in scores.values()) and abs(sum(scores.values()) - 1) < 1e-5
    active, _, _ = graph.walk(BRANCH, [("first", 1.0)], 64, 512, 3)
    assert {t: round(s, 6) for t, (s, _) in active.items()} != {t: round(s, 6) for t, s in scores.items()}
    assert active["second"][0] == pytest.approx(0.25)


def test_isolated_seed_settles_at_its_restart():
    scores, _, converged = graph.diffuse([], {"x": 1.0}, 10, 10)
    assert scores["x"] == pytest.approx(0.35) and converged


def test_star_stays_within_budgets():
    star = both([("hub", f"leaf{i}", 0.5) for i in range(10_000)])
    active, visits, truncated = graph.walk(star, [("hub", 1.0)], 64, 512, 3)
    assert visits <= 512 and len(active) <= 64 and truncated


def test_joins_agree_with_walks(spark):
    r = np.random.default_rng(1)
    edges = both([(f"t{a}", f"t{b}", float(r.uniform(0.05, 0.9))) for a, b in {tuple(sorted(p)) for p in r.integers(0, 30, (90, 2)).tolist() if p[0] != p[1]}])
    df = spark.createDataFrame([(a, b, b, s) for a, b, s in edges], "src string, dst string, dst_id string, signal double")
    seeds = {"t0": 1.0, "t5": 0.55}
    free, _, _ = graph.walk(edges, sorted(seeds.items()), 10**6, 10**6, 3)
    bounded = {x.tag: x.score for x in graph.bounded_activation(df, sorted(seeds.items()), 10**6, 10**6, 3).collect()}
    assert bounded == pytest.approx({t: s for t, (s, _) in free.items()})
    joined = {x.tag: x.score for x in graph.activation(df, seeds, 3).collect()}
    assert joined.keys() == free.keys() and all(joined[t] >= free[t][0] - 1e-5 for t in joined)
    spread, _, _ = graph.diffuse(edges, seeds, 10**6, 10**6)
    assert {x.tag: x.score for x in graph.diffusion(df, seeds).collect()} == pytest.approx(spread, abs=1e-4)


def test_tag_basis():
    b = vectors.tag_basis([1, 2], [[1, 0], [0, 1]])
    assert b.rank == 2 and b.explained == pytest.approx(1) and np.allclose(b.residual, 0) and not b.searchable
    b = vectors.tag_basis([0, 1], [[1, 0]])
    assert not b.used and b.rank == 1 and np.allclose(b.residual, [0, 1])
    assert vectors.tag_basis([1.0, 0.0], []).used is False


def pool(spark, rows):
    """(channel, space, memory, rank)"""
    df = spark.createDataFrame([(c, s, m, f"r{m}", k) for c, s, m, k in rows], "channel string, space_id string, memory_id long, revision_id string, rank long")
    parts = [fusion.pool_rows(c, df.where(F.col("channel") == c), n_exact=F.lit(1)) for c in sorted({r[0] for r in rows})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_reciprocal_ranks(spark):
    got = fusion.fuse(pool(spark, [("x", "s", 1, 0), ("x", "s", 2, 1), ("y", "s", 2, 0), ("y", "s", 1, 1)])).collect()
    assert len(got) == 2 and all(g.rrf == pytest.approx(1 / 60 + 1 / 61) for g in got)
    got = fusion.fuse(pool(spark, [("x", "other", 1, 0), ("x", "s", 2, 1)]), ["s"], 1).collect()
    assert [g.memory_id for g in got] == [2] and got[0].rrf == pytest.approx(1 / 61)
    got = fusion.fuse(pool(spark, [("x", "s", 1, 0), ("x", "s", 1, 1), ("x", "s", 2, 2)])).orderBy("memory_id").collect()
    assert [g.suppressed for g in got] == [1, 0] and got[1].rrf == pytest.approx(1 / 61)


def test_many_weak_memories_do_not_outweigh_a_strong_one(spark):
    rows = [("s", 0, "r", 0.9, ["exact"])] + [("s", i, "r", 0.1, ["lexical"]) for i in range(1, 21)]
    top = fusion.consolidate(spark.createDataFrame(rows, "space_id string, memory_id long, revision_id string, score double, kinds array<string>"), 5).collect()
    assert top[0].memory_id == 0 and len(top) == 5
    rows = [("s", 1, "r", 0.5, ["exact"]), ("s", 1, "r", 0.4, ["exact"]), ("s", 1, "r", 0.3, ["lexical"])]
    (one,) = fusion.consolidate(spark.createDataFrame(rows, "space_id string, memory_id long, revision_id string, score double, kinds array<string>"), 5).collect()
    assert one.score == pytest.approx(0.5 + 0.5 * (1 - np.exp(-0.3))) and one.families == 2


def test_bonuses_are_bounded(spark):
    df = spark.range(0, 200).select(S.support_bonus(F.col("id"), F.col("id") / 10, F.col("id") / 5).alias("s"), S.structure_bonus(F.col("id") / 20, F.col("id") % 3, F.col("id") > 3).alias("t"), S.relation_bonus(F.col("id")).alias("r"))
    m = df.agg(F.max("s"), F.max("t"), F.max("r"), F.min("s")).first()
    assert m[0] <= 0.12 and m[1] <= 0.08 and m[2] <= 0.05 and m[3] >= 0
    assert fusion.assess(spark.createDataFrame([], "relevance double, confidence double, accessibility double, effort double, families int")).first().mean_confidence == 0.0


def test_evidence_is_trimmed_across_arrays(spark):
    df = spark.createDataFrame([([1, 2], [3, 4, 5], [6])], "a array<int>, b array<int>, c array<int>")
    r = fusion.trim_evidence(df, ["a", "b", "c"], 4).first()
    assert (r.a, r.b, r.c) == ([1, 2], [3, 4], [])


def test_rerank_answers_are_checked():
    rerank.check(["a", "b"], [("b", 1.0), ("a", 0.0)])
    for bad in ([("a", 1.0)], [("a", 1.0), ("c", 0.5)], [("a", 1.5), ("b", 0.1)], [("a", float("nan")), ("b", 0.1)], [("a", 0.1), ("a", 0.2)]):
        with pytest.raises(ValueError):
            rerank.check(["a", "b"], bad)


def test_prior_breaks_ties_only(spark):
    events = spark.createDataFrame([(i, "s", 2, "used", 10**15, "t") for i in range(5)], "event_id long, space_id string, memory_id long, outcome string, micros long, tag string")
    prior = adaptive.priors(adaptive.familiarity(events), adaptive.affinity(events), ["s"], ["t"], 10**9)
    assert 0 < prior.first().prior <= 0.1
    rows = spark.createDataFrame([("s", 1, "r", 0.5), ("s", 2, "r", 0.5), ("s", 3, "r", 0.500001)], "space_id string, memory_id long, revision_id string, relevance double")
    assert [r.memory_id for r in adaptive.tie_break(rows, prior).collect()] == [3, 2, 1]
    assert adaptive.priors(adaptive.familiarity(events), adaptive.affinity(events), ["other"], ["t"], 10**9).count() == 0


def test_checkpoint_and_tail_are_all_events(spark):
    ev = spark.createDataFrame([(i, "s", i % 3, ["used", "rejected", "sufficient"][i % 3 - 1], i, "t") for i in range(60)], "event_id long, space_id string, memory_id long, outcome string, micros long, tag string")
    whole = adaptive.familiarity(ev).orderBy("memory_id").collect()
    parts = adaptive.merge_states(adaptive.familiarity(ev.where("event_id < 31")), adaptive.familiarity(ev.where("event_id >= 31"))).orderBy("memory_id").collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in parts]


def test_acceptance():
    base = {"recall": 0.5, "ndcg": 0.4, "p95": 10.0}
    assert metrics.accept(base, {"recall": 0.6, "ndcg": 0.5, "p95": 12.0}) == []
    assert set(metrics.accept(base, {"recall": 0.4, "ndcg": 0.3, "p95": 30.0, "violations": 1})) == {"recall gain", "ndcg gain", "ndcg loss", "p95", "constraint violations"}


def test_seeds_keep_the_larger_weight():
    assert tags.seeds(["a"], [("a", "generated", 0.9), ("b", "semantic", 0.9), ("c", "exact-support", 0.1)], False, 5) == {"a": 1.0, "c": 0.95}


def store(spark):
    rows = [("s", 1, "r1", "career work building systems", ["person:ann"], ["work"], True, False), ("s", 2, "r2", "holiday by the sea", [], ["rest"], True, False), ("s", 3, "r3", "career in music", [], ["work"], True, True), ("t", 4, "r4", "career elsewhere", [], ["work"], True, False)]
    df = spark.createDataFrame(rows, "space_id string, memory_id long, revision_id string, text string, entity_refs array<string>, tags array<string>, current boolean, retired boolean")
    df = df.withColumns({"node_ids": F.array().cast("array<string>"), "relations": F.array().cast("array<string>"), "purged": F.lit(False), "generation": F.lit(1).cast("long"), "valid_until": F.lit(None).cast("long")})
    return Store(df, Snapshot(3, 3))


def test_engine_scope_never_leaks_and_limits_hold(spark):
    st = store(spark)
    got = run(st, Query(spaces=("s",), text=("career",))).results.collect()
    assert [r.memory_id for r in got] == [1]
    assert [r.memory_id for r in run(st, Query(spaces=("s",), entities=("person:ann",))).results.collect()] == [1]
    assert run(st, Query(spaces=("s",), memories=(1, 2))).results.count() == 0
    a = run(st, Query(spaces=("s", "t"), max_results=2))
    assert a.results.count() == 2 and a.assessment.first().result_count == 2
    assert run(st, Query(spaces=("s",), text=("nothing like it",))).assessment.first().result_count == 0
    assert run(st, Query(spaces=("s",), text=("career",), strict=True, min_relevance=0.9)).results.count() == 0
