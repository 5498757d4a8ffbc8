import pytest

from stratalens.operators import graph, integrity, lexical, rerank, vectors
from stratalens.operators.filters import semantic_scope
from stratalens.operators.providers import ProviderError
from stratalens.plans.engine import Store, run
from stratalens.plans.query import Query, QueryError, Snapshot
from stratalens.sources.store import VersionedStore

RECORD = "space_id string, memory_id long, revision_id string, text string, entity_refs array<string>, tags array<string>, node_ids array<string>, relations array<string>, current boolean, retired boolean, purged boolean, generation long, valid_until long"


def records(spark, rows):
    return spark.createDataFrame([(s, m, f"r{m}", t, [], [], [], [], True, False, False, 1, None) for s, m, t in rows], RECORD)


def test_a_small_space_beside_a_large_nearer_one(spark):
    """The cap counts vectors of the scope alone."""
    rows = [("large", i, "x") for i in range(100)] + [("small", 1000 + i, "x") for i in range(5)]
    v = spark.createDataFrame([(s, m, [1.0, 0.001 * (m % 100)] if s == "large" else [0.2, 1.0 + 0.01 * m]) for s, m, _ in rows], "space_id string, memory_id long, vector array<double>")
    got = vectors.semantic_channel(v, records(spark, rows), [1.0, 0.0], semantic_scope(["small"], 1), 32, 10)
    assert [r.memory_id for r in got.orderBy("rank").collect()] == [1000, 1001, 1002, 1003, 1004]


def branching(n):
    """A chain with a side branch merged in every 100 revisions."""
    edges = [(f"m{i}", f"m{i - 1}") for i in range(1, n)]
    for i in range(100, n, 100):
        edges += [(f"m{i}", f"b{i}"), (f"b{i}", f"m{i - 50}")]
    return edges


def test_ancestors_of_any_depth(spark):
    edges = branching(3000)
    got = {r.revision_id: r.depth for r in graph.ancestors(spark.createDataFrame(edges, "revision_id string, parent_id string"), "m2999").collect()}
    up = {}
    for a, b in edges:
        up.setdefault(a, []).append(b)
    want, front, depth = {}, ["m2999"], 0
    while front:
        depth, front = depth + 1, sorted({b for a in front for b in up.get(a, ())} - set(want))
        want |= {b: depth for b in front}
    assert got == want and graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "revision_id string, parent_id string"), "a").count() == 1


def test_a_long_chain_has_no_cycle_and_rings_behind_it_are_found(spark):
    edges = branching(1200) + [("m0", "z0"), ("z0", "z1"), ("z1", "z0"), ("z1", "tail")]
    assert {r[0] for r in integrity.in_cycles(spark.createDataFrame(edges, "revision_id string, parent_id string")).collect()} == {"z0", "z1"}
    assert integrity.in_cycles(spark.createDataFrame(branching(1200), "revision_id string, parent_id string")).count() == 0


def test_edges_are_counted_once_for_both_directions(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_EDGES", 10)
    both = lambda n: spark.createDataFrame([(f"t{i + a}", f"t{i + b}", f"t{i + b}", 0.5) for i in range(n) for a, b in ((0, 1), (1, 0))], "src string, dst string, dst_id string, signal double")
    assert graph.bounded_activation(both(10), [("t0", 1.0)], 50, 500, 3).count() == 4
    with pytest.raises(ValueError):
        graph.bounded_activation(both(11), [("t0", 1.0)], 50, 500, 3)


def test_reranking_asks_the_provider_for_more_than_it_returns(spark):
    texts = [("s", i, f"word {'x' * i}") for i in range(30)]
    store = Store(records(spark, texts), Snapshot(1, 1))
    asked: list[str] = []

    def longest(some):
        asked.extend(some)
        return [len(t) / 100 for t in some]

    q = Query(spaces=("s",), text=("word",), preferred=("reranking",), max_results=5, max_candidates=200)
    got = run(store, q, reranker=longest)
    assert got.plan.rerank and len(asked) == len(set(asked))
    order = [len(r.text) for r in got.results.collect()]
    assert order == sorted(order, reverse=True) and len(order) == 5
    plain = run(store, q)
    assert plain.plan.degraded == ("reranking",) and [r.memory_id for r in plain.results.collect()]

    bad = run(store, q, reranker=lambda some: [7.0] * len(some))
    assert "reranking" in bad.plan.degraded and bad.results.count() == 5
    with pytest.raises((ProviderError, ValueError)):
        run(store, Query(spaces=("s",), text=("word",), required=("reranking",)), reranker=lambda some: [2.0] * len(some))
    with pytest.raises(QueryError):
        run(store, Query(spaces=("s",), text=("word",), required=("reranking",)))
    with pytest.raises(ProviderError):
        rerank.ask(spark.createDataFrame([("h", "t")], "handle string, text string"), lambda some: [])


def test_one_writer_publishes_a_generation(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = VersionedStore(spark, root), VersionedStore(spark, root)
    rows = lambda n: spark.range(n).toDF("x")
    one.publish({"t": rows(3)}, expected=0)
    read = two.newest()
    one.publish({"t": rows(4)}, expected=1)
    two.newest = lambda: read  # it has read before the other has published
    with pytest.raises(ValueError, match="another writer"):
        two.publish({"t": rows(9)}, expected=1)
    assert VersionedStore(spark, root).read("t").count() == 4 and one.verify() == []
    one.backup(f"file://{tmp_path}/copy")
    again = VersionedStore.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/again")
    assert again.read("t").count() == 4 and [r.name for r in again.inspect().collect()] == ["t"]


def test_an_index_reads_its_terms_alone(spark, tmp_path):
    rows = records(spark, [("s", i, f"common word{i % 7} " + "pad " * (i % 3)) for i in range(200)])
    lexical.write_index(rows, f"file://{tmp_path}/index")
    index = lexical.open_index(spark, f"file://{tmp_path}/index")
    near = lambda df: {r.memory_id: round(r.score, 9) for r in df.collect()}
    assert near(lexical.bm25(index, "word3 pad missing")) == near(lexical.bm25(rows, "word3 pad missing"))
    plan = lexical.bm25(index, "word3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") and "term" in plan
