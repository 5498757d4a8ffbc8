"""Hard constraints: what a channel may return at all. All are plain predicates, pushed down by Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions.text import contains_any
from stratalens.model import visible_at


def in_scope(spaces: list[str]) -> Column:
    return F.col("space_id").isin(list(spaces))


def has_all(column: str, wanted: list[str]) -> Column:
    """Every wanted value is in the array, compared as it is."""
    return reduce(lambda a, b: a & b, (F.array_contains(column, w) for w in wanted), F.lit(True))


def any_memory(references: list[tuple[int, str | None]]) -> Column:
    """Any of the references, each a memory or one revision of it."""
    one = lambda r: (F.col("memory_id") == r[0]) & (F.lit(True) if r[1] is None else F.col("revision_id") == r[1])
    return reduce(lambda a, b: a | b, map(one, references), F.lit(False)) if references else F.lit(True)


def all_memories(ids: list[int]) -> Column:
    """Each id must be the row's own: two different ones leave nothing."""
    return reduce(lambda a, b: a & b, (F.col("memory_id") == i for i in ids), F.lit(True))


def constraints(spaces: list[str], memories: list[int] = (), entities: list[str] = (), tags: list[str] = ()) -> Column:
    return in_scope(spaces) & all_memories(list(memories)) & has_all("entity_refs", list(entities)) & has_all("tags", list(tags))


def live(at: int) -> Column:
    return F.col("current") & ~F.col("retired") & ~F.col("purged") & visible_at(F.col("generation"), F.col("valid_until"), at)


def exact_match(spaces: list[str], at: int, references: list[tuple[int, str | None]] = (), memories: list[int] = (), entities: list[str] = (), tags: list[str] = ()) -> Column:
    return constraints(spaces, memories, entities, tags) & live(at) & any_memory(list(references))


def lexical_match(spaces: list[str], cues: list[str], memories: list[int] = (), entities: list[str] = (), tags: list[str] = ()) -> Column:
    return constraints(spaces, memories, entities, tags) & F.col("current") & ~F.col("retired") & contains_any(F.col("text"), list(cues))


def finite_score() -> Column:
    score = F.col("score")
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def semantic_scope(spaces: list[str], at: int, memories: list[int] = (), entities: list[str] = (), tags: list[str] = ()) -> Column:
    """What a record must be for its vectors to count."""
    return constraints(spaces, memories, entities, tags) & live(at)


def semantic_match(spaces: list[str], at: int, memories: list[int] = (), entities: list[str] = (), tags: list[str] = ()) -> Column:
    return finite_score() & semantic_scope(spaces, at, memories, entities, tags)


def history_match(spaces: list[str], at: int, cues: list[str] = (), memories: list[int] = (), entities: list[str] = (), tags: list[str] = ()) -> Column:
    """Current and retired rows alike, up to a generation."""
    text = contains_any(F.col("text"), list(cues)) if cues else F.lit(True)
    return constraints(spaces, memories, entities, tags) & ~F.col("purged") & (F.col("generation") <= at) & text
