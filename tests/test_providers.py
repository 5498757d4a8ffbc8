import pytest

from stratalens.operators import history, providers, vectors
from stratalens.plans.query import Continuation, NotReady, Query, QueryError, Snapshot, wait_ready


def test_retries_and_pauses():
    pauses, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 4:
            raise OSError("busy")
        return texts

    assert providers.retried(flaky, pause=pauses.append)(["a"]) == ["a"] and pauses == [0.5, 1.0, 2.0]
    with pytest.raises(providers.ProviderError):
        providers.retried(lambda t: 1 / 0, attempts=2, pause=pauses.append)(["a"])


def test_answers_are_checked():
    providers.check_embeddings(["a"], [[1.0, 2.0]], 2)
    for bad in ([], [[1.0]], [[1.0, float("nan")]]):
        with pytest.raises(providers.ProviderError):
            providers.check_embeddings(["a"], bad, 2)


def test_embedding_frames(spark):
    df = spark.createDataFrame([(1, "a", "h1"), (2, "a", "h1"), (3, None, "h2"), (4, "b", "h3")], "k long, text string, input_hash string")
    by = {r.k: r.vector for r in providers.embed(df, "text", providers.hash_embedding(8), 8).collect()}
    assert by[1] == by[2] != by[4] and by[3] is None and sum(x * x for x in by[1]) == pytest.approx(1)
    have = spark.createDataFrame([("h1",)], "input_hash string")
    assert {r.input_hash for r in providers.embed_missing(df, have, "text", providers.hash_embedding(8), 8).collect()} == {"h2", "h3"}
    assert vectors.selected(df, k=1, text=None).count() == 1


def test_spaces(spark):
    states = spark.createDataFrame([("a", "key", "active", "deny", 1, None)], "space_id string, space_key string, lifecycle string, policy string, valid_from long, valid_to long")
    two = history.create_space(states, "b", "other", 2, policy="local-only")
    moved = history.change_space(two, "b", 3, lifecycle="retired", policy="deny")
    assert moved.count() == 3 and moved.where("space_id = 'b' and valid_to is null").first().lifecycle == "retired"
    for bad in (lambda: history.create_space(two, "c", "key", 3), lambda: history.change_space(two, "b", 3, space_key="key"), lambda: history.change_space(two, "z", 3, lifecycle="active")):
        with pytest.raises(history.Conflict):
            bad()


def test_waiting_and_continuations():
    built = iter([1, 1, 3])
    assert wait_ready(Query(spaces=("a",), at_least=3), lambda: Snapshot(3, next(built)), sleep=lambda s: None) == 3
    now = iter([0.0, 9.0])
    with pytest.raises(NotReady):
        wait_ready(Query(spaces=("a",), at_least=3), lambda: Snapshot(3, 1), clock=lambda: next(now), sleep=lambda s: None)
    q = Query(spaces=("a",), text=("x",))
    c = Continuation.of(q, 7, 20, now=0.0)
    assert c.resume(q, 10.0) == (20, 7)
    for other, at in ((Query(spaces=("a",)), 10.0), (q, 901.0)):
        with pytest.raises(QueryError):
            c.resume(other, at)
