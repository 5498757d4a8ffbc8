import pytest

from stratalens.plans.query import PROFILES, NotReady, Query, QueryError, Snapshot, plan, target_generation

READY = Snapshot(10, 10)


def code(**q):
    with pytest.raises(QueryError) as e:
        plan(Query(**q), READY)
    return e.value.code


def test_validation():
    assert code(spaces=()) == "EMPTY_SCOPE"
    assert code(spaces=("a", "a")) == "DUPLICATE_SPACE"
    assert code(spaces=("a",), text=(" ",)) == "BLANK_TEXT"
    assert code(spaces=("a",), tags=("",)) == "BLANK_TAG"
    assert code(spaces=("a",), required=("telepathy",)) == "UNKNOWN_CAPABILITY"
    assert code(spaces=("a",), required=("semantic",), preferred=("semantic",)) == "CAPABILITY_TWICE"
    assert code(spaces=("a",), max_results=0) == "ZERO_BUDGET"
    assert code(spaces=("a",), min_relevance=1.5) == "MIN_RELEVANCE"


def test_channels():
    channels = lambda **q: plan(Query(spaces=("a",), **q), READY).channels
    assert channels() == ("exact",)
    assert channels(text=("x",)) == ("lexical",)
    assert channels(text=("x",), entities=("a:b",)) == ("exact", "lexical")
    assert channels(text=("x",), valid_at="2024") == ("exact", "lexical")
    assert channels(text=("x",), preferred=("semantic",)) == ("lexical", "semantic-direct", "semantic-residual")
    assert channels(text=("x",), preferred=("associative",)) == ("lexical",)
    assert channels(text=("x",), cue_tags=("t",), preferred=("associative",)) == ("lexical", "tag-readout", "activation", "relation")
    assert "diffusion" in channels(text=("x",), preferred=("semantic", "associative"), quality="thorough")


def test_capabilities_degrade_or_fail():
    some = Snapshot(5, 5, frozenset({"lexical"}))
    assert plan(Query(spaces=("a",), text=("x",), preferred=("semantic",)), some).degraded == ("semantic",)
    with pytest.raises(QueryError):
        plan(Query(spaces=("a",), required=("semantic",)), some)
    with pytest.raises(QueryError):
        plan(Query(spaces=("a",), text=("x",), required=("semantic",)), READY, denied=frozenset({"semantic"}))


def test_generations():
    lag = Snapshot(10, 8)
    assert target_generation(Query(spaces=("a",)), lag) == 8
    assert target_generation(Query(spaces=("a",), generation=3), lag) == 3
    with pytest.raises(NotReady):
        target_generation(Query(spaces=("a",), at_least=9), lag)
    with pytest.raises(QueryError):
        target_generation(Query(spaces=("a",), generation=11), lag)


def test_profiles_grow():
    fast, balanced, thorough = (PROFILES[q] for q in ("fast", "balanced", "thorough"))
    assert fast.lexical < balanced.lexical < thorough.lexical and fast.diffusion_nodes == 0 < thorough.diffusion_nodes
