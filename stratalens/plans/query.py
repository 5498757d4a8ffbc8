"""Queries: what can be asked, its validation, and which channels answer it. Nothing here touches data."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

#: What a store may offer.
CAPABILITIES = ("lexical", "semantic", "associative", "adaptive", "reranking")
CHANNELS = ("exact", "lexical", "semantic-direct", "semantic-residual", "tag-readout", "activation", "diffusion", "relation")
HISTORY = ("current", "at-generation", "all-revisions", "changes")


class QueryError(ValueError):
    """A query that can't be answered as it stands; ``code`` says why."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code} {message}".strip())
        self.code = code


@dataclass(frozen=True)
class Profile:
    """The bounds of each channel's work. The figures below are fixed values."""

    lexical: int
    semantic: int
    residual: int
    readout: int
    basis: int
    tags: int
    edges: int
    hops: int
    diffusion_nodes: int
    relation_hops: int
    relation_added: int
    rerank: int


PROFILES = {
    "fast": Profile(32, 32, 16, 24, 12, 48, 512, 2, 0, 1, 16, 16),
    "balanced": Profile(64, 64, 32, 48, 24, 96, 1024, 3, 0, 1, 32, 32),
    "thorough": Profile(128, 128, 64, 96, 48, 192, 4096, 4, 256, 2, 64, 64),
}


@dataclass(frozen=True)
class Query:
    spaces: tuple[str, ...]
    text: tuple[str, ...] = ()
    cue_memories: tuple[tuple[int, str | None], ...] = ()
    cue_tags: tuple[str, ...] = ()
    cue_entities: tuple[str, ...] = ()
    memories: tuple[int, ...] = ()
    entities: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    lifecycle: str | None = None
    valid_at: str | None = None
    history: str = "current"
    generation: int | None = None
    at_least: int | None = None
    required: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    quality: str = "balanced"
    max_results: int = 10
    max_matches: int = 3
    max_candidates: int = 200
    max_evidence: int = 1500
    min_relevance: float | None = None
    timeout_ms: int = 5000
    query_vector: tuple[float, ...] | None = None
    strict: bool = False

    def validate(self) -> None:
        def need(ok: bool, code: str) -> None:
            if not ok:
                raise QueryError(code)

        need(bool(self.spaces), "EMPTY_SCOPE")
        need(len(set(self.spaces)) == len(self.spaces), "DUPLICATE_SPACE")
        need(all(t.strip() for t in self.text), "BLANK_TEXT")
        need(all(t.strip() for t in (*self.cue_tags, *self.tags)), "BLANK_TAG")
        named = (*self.required, *self.preferred)
        need(all(c.strip() for c in named), "BLANK_CAPABILITY")
        need(set(named) <= set(CAPABILITIES), "UNKNOWN_CAPABILITY")
        need(len(set(named)) == len(named), "CAPABILITY_TWICE")
        need(min(self.max_results, self.max_matches, self.max_candidates, self.max_evidence, self.timeout_ms) > 0, "ZERO_BUDGET")
        need(self.min_relevance is None or 0.0 <= self.min_relevance <= 1.0, "MIN_RELEVANCE")
        need(self.quality in PROFILES, "UNKNOWN_QUALITY")
        need(self.history in HISTORY, "UNKNOWN_HISTORY")


@dataclass(frozen=True)
class Plan:
    channels: tuple[str, ...]
    profile: Profile
    used: frozenset[str]
    degraded: tuple[str, ...]
    generation: int
    rerank: bool
    adaptive: bool


@dataclass
class Snapshot:
    """What a store can serve: its newest generation, the newest built one, and its capabilities."""

    newest: int
    built: int
    capabilities: frozenset[str] = field(default_factory=lambda: frozenset(CAPABILITIES))


class NotReady(QueryError):
    """The generation asked for isn't built yet."""


def target_generation(query: Query, snapshot: Snapshot) -> int:
    """Latest, at least, or pinned."""
    wanted = query.generation if query.generation is not None else max(snapshot.built, query.at_least or 0)
    if wanted > snapshot.newest:
        raise QueryError("GENERATION_UNKNOWN", str(wanted))
    if wanted > snapshot.built:
        raise NotReady("READINESS_PENDING", str(wanted))
    return wanted


def plan(query: Query, snapshot: Snapshot, denied: frozenset[str] = frozenset()) -> Plan:
    """Which channels run. Required capabilities that are missing or denied are an error, preferred ones degrade."""
    query.validate()
    offered = snapshot.capabilities - denied
    for c in query.required:
        if c not in offered:
            raise QueryError("CAPABILITY_UNAVAILABLE", c)
    used = frozenset(query.required) | (frozenset(query.preferred) & offered)
    degraded = tuple(c for c in query.preferred if c not in offered)
    channels: list[str] = []
    if not query.text or query.cue_memories or query.memories or query.tags or query.entities or query.valid_at or query.lifecycle or query.history != "current":
        channels.append("exact")
    if query.text:
        channels.append("lexical")
    semantic = "semantic" in used and bool(query.text)
    if semantic:
        channels += ["semantic-direct", "semantic-residual"]
    if "associative" in used and (query.cue_tags or "semantic" in used):
        channels += ["tag-readout", "activation", *["diffusion"] * (query.quality == "thorough"), "relation"]
    return Plan(tuple(channels), PROFILES[query.quality], used, degraded, target_generation(query, snapshot), "reranking" in used, "adaptive" in used)


def wait_ready(query: Query, snapshot: Callable[[], Snapshot], pause: float = 0.025, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """The target generation, asking again while it isn't built, until the query's timeout."""
    end = clock() + query.timeout_ms / 1000
    while True:
        try:
            return target_generation(query, snapshot())
        except NotReady:
            if clock() >= end:
                raise
            sleep(pause)


@dataclass(frozen=True)
class Continuation:
    """Where a listing goes on: an offset that holds for one query on one generation, for a while."""

    offset: int
    generation: int
    fingerprint: str
    expires_at: float

    @staticmethod
    def of(query: Query, generation: int, offset: int, now: float, ttl: float = 900.0) -> Continuation:
        return Continuation(offset, generation, fingerprint(query), now + ttl)

    def resume(self, query: Query, now: float) -> tuple[int, int]:
        """(offset, generation), if the query is the same and the time isn't over."""
        if self.fingerprint != fingerprint(query):
            raise QueryError("CONTINUATION_QUERY")
        if now >= self.expires_at:
            raise QueryError("CONTINUATION_EXPIRED")
        return self.offset, self.generation


def fingerprint(query: Query) -> str:
    """The same for queries that ask the same."""
    return hashlib.sha256(repr(sorted(asdict(query).items())).encode()).hexdigest()
