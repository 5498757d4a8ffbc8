"""Near-duplicates by SimHash: a segment-popcount embedding, a grid join and exact checks.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors is at most the Hamming distance of the fingerprints. Of two fingerprints that differ in
at most ``max_bits`` (up to 5) bits, one half of the vector (16 segments) therefore differs by at most
``max_bits // 2``, at most 2. Both enter the grid cell of each half and the cells next to it (one count more or
less), so such halves always share a cell: the cell itself for distance 0, and for 1 or 2 one halfway.
In a cell the Manhattan distance of the whole vectors discards pairs first; what it leaves is compared
exactly.

A cell of more than ``LARGE_CELL`` fingerprints is dealt again: of the other half's vector, one of its
halves differs by at most ``max_bits // 2`` as well, so the cell's members enter the grid cells of both
(and their neighbours) below it. So the fingerprints around the grid's mode are spread over many tasks.

A cell never gives all its pairs. Small cells are compared in place, large ones searched breadth
first among what isn't yet reached, and every task hands on one tree for each set that it has found
connected: a heap-shaped one, so that no node has more than three edges from a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import documents, free_name, materialise, shuffle_width, small_batches, tell_entries, text_or_empty, with_entry_ids
from stratalens.llm.components import connected_components
from stratalens.llm.jaccard_dedup import drop_similar_texts

SEED = 42
#: Identifiers in an entry at most, documents that a task gathers before it writes entries.
ENTRY_IDS, FLUSH_ROWS = 1_000, 200_000
#: A cell with more members than this is searched breadth first; one with more than that is dealt again.
SMALL_CELL, LARGE_CELL = 64, 20_000
#: Fingerprints that a task keeps in its sets; beyond, it hands on their trees and begins anew.
HELD_SETS = 500_000
#: Bits at which fingerprints propose pairs for an exact check.
EXACT_BITS = 4
_SEGMENTS, _HALF = 32, 16
_POWERS = 3 ** np.arange(_HALF, dtype=np.int64)
_ODD = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of one text: lower-cased A-Z, words between ASCII white space, ``words``-word shingles with repeats."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed, of = xxhash.xxh64_intdigest, min(words, len(parts))
    values = [hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[of - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 65_536):
        block = np.array(values[at : at + 65_536], np.uint64)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_ENTRY = pa.schema([("fp", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _fingerprint_entries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(fp, ids[at : at + ENTRY_IDS]) for fp, ids in groups.items() for at in range(0, len(ids), ENTRY_IDS)]
            for at in range(0, len(rows), 20_000):
                fps, ids = zip(*rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], schema=_ENTRY)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                groups.setdefault(_signed(fingerprint(text.as_py(), words)), []).append(doc)
            held += batch.num_rows
            if held >= FLUSH_ROWS:
                yield from flush()
                groups.clear()
                held = 0
        yield from flush()

    return run


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 two-bit segments of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def thermometer(fps: np.ndarray) -> np.ndarray:
    """Each segment's bit count as so many ones: two such values differ in as many bits as the vectors' Manhattan distance."""
    high = fps >> np.uint64(1)
    return ((fps | high) & _ODD) | ((fps & high & _ODD) << np.uint64(1))


def _near_cells(part: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
    """(cell, whose) of vectors of segment counts: the grid cell of each, and with ``reach`` those next to it."""
    code = part @ _POWERS[: part.shape[1]]
    yield code, slice(None)
    for j in range(part.shape[1] if reach else 0):
        for step in (-1, 1):
            ok = part[:, j] > 0 if step < 0 else part[:, j] < 2
            yield code[ok] + step * _POWERS[j], ok


_CELL = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])


def _cells(reach: int):
    """Rows (cell, fp): the grid cells of both halves, and with ``reach`` the cells next to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(every), 20_000):
                fps = every[at : at + 20_000]
                counts = segment_counts(fps.view(np.uint64)).astype(np.int64)
                for half in (0, 1):
                    cells = [(c + half * 3**_HALF, fps[who]) for c, who in _near_cells(counts[:, half * _HALF : (half + 1) * _HALF], reach)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cells)], schema=_CELL)

    return run


def _cells_below(reach: int):
    """Of members of large cells (cell, fp): rows (cell below, fp) by both halves of the half that the cell doesn't speak of."""
    eight = _HALF // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(cell), 20_000):
                own, fps = cell[at : at + 20_000], fp[at : at + 20_000]
                counts = segment_counts(fps.view(np.uint64)).astype(np.int64)
                other = np.where((own < 3**_HALF)[:, None], counts[:, _HALF:], counts[:, :_HALF])
                for part in (0, 1):
                    below = [((2 * own[who] + part) * 3**eight + c, fps[who]) for c, who in _near_cells(other[:, part * eight : (part + 1) * eight], reach)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*below)], schema=_CELL)

    return run


class _Sets:
    """Union-find over fingerprints."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def trees(self) -> Iterator[tuple[int, int]]:
        """Edges of a heap-shaped tree over the sorted members of each set."""
        members: dict[int, list[int]] = {}
        for x in list(self.up):
            members.setdefault(self.root(x), []).append(x)
        for own in members.values():
            own.sort()
            for i in range(1, len(own)):
                yield own[(i - 1) // 2], own[i]


def _search(members: np.ndarray, bits: int, sets: _Sets) -> None:
    """Link what is connected within one large cell; each step looks only at what isn't reached yet."""
    rest, flat = members, thermometer(members)
    while len(rest):
        stack, rest, flat = [rest[0]], rest[1:], flat[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.flatnonzero(np.bitwise_count(flat ^ thermometer(at)) <= bits)
            near = near[np.bitwise_count(rest[near] ^ at) <= bits]
            if len(near):
                found = rest[near]
                rest, flat = np.delete(rest, near), np.delete(flat, near)
                here = int(at.view(np.int64))
                for x in found.view(np.int64).tolist():
                    sets.link(here, x)
                stack.extend(found)


def _pairs_within(cell: np.ndarray, fp: np.ndarray, bits: int, sets: _Sets) -> None:
    """Link what is within ``bits`` in the same small cell: Manhattan distances first, then the fingerprints themselves."""
    flat, pairs = thermometer(fp), []
    for lag in range(1, SMALL_CELL):
        same = cell[lag:] == cell[:-lag]
        if not same.any():
            break
        near = np.flatnonzero(same)
        near = near[np.bitwise_count(flat[near] ^ flat[near + lag]) <= bits]
        a, b = fp[near], fp[near + lag]
        near = np.bitwise_count(a ^ b) <= bits
        pairs.append(np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])], axis=1))
    if pairs and sum(map(len, pairs)):
        for a, b in np.unique(np.concatenate(pairs), axis=0).view(np.int64).tolist():
            sets.link(a, b)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])


def _link_cells(bits: int, large: int | None):
    """Of sorted rows (cell, fp): links (a, b, null), and the members of cells larger than ``large`` as (fp, null, cell)."""

    def rows(a, b, cell) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, cell), _LINK)], schema=_LINK)

    def links(sets: _Sets) -> Iterator[pa.RecordBatch]:
        edges = list(sets.trees())
        for at in range(0, len(edges), 50_000):
            a, b = zip(*edges[at : at + 50_000])
            yield rows(a, b, [None] * len(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        held: list[np.ndarray] = []  # fingerprints so far of the last cell, which may go on
        last, size = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if size > (large or size):
                for fp in held:  # the beginning went out already
                    yield rows(fp, [None] * len(fp), np.full(len(fp), last))
            elif size > SMALL_CELL:
                _search(np.concatenate(held), bits, sets)
            elif size > 1:
                _pairs_within(np.full(size, last), np.concatenate(held).view(np.uint64), bits, sets)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            sizes = np.diff(starts)
            whole = np.ones(len(sizes), bool)
            whole[-1] = False  # may go on in the next batch
            if last is not None and cell[0] == last:
                whole[0] = False
            small = np.repeat(whole & (sizes <= SMALL_CELL), sizes)
            _pairs_within(cell[small], fp[small], bits, sets)
            for n in np.flatnonzero(~(whole & (sizes <= SMALL_CELL))).tolist():
                s, e = int(starts[n]), int(starts[n + 1])
                if last is not None and cell[s] != last:
                    yield from close()
                    held, size = [], 0
                last = cell[s]
                held.append(fp[s:e].copy())
                size += e - s
                if large is not None and size > large:  # dealt again: nothing of it stays here
                    for some in held:
                        yield rows(some.view(np.int64), [None] * len(some), np.full(len(some), last))
                    held = []
            if len(sets.up) > HELD_SETS:
                yield from links(sets)
                sets = _Sets()
        if last is not None:
            yield from close()
        yield from links(sets)

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, large_cell: int = LARGE_CELL) -> DataFrame:
    """One row for each row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ in at most ``max_bits`` bits (0 to 5) are linked; component_id is
    the smallest doc_id that links lead to. Texts with the same fingerprint are one node; their
    copies aren't expanded into pairs, and no link is lost.

    Nulls: a null text counts as empty, with fingerprint zero; null ids are returned, and count only
    where a component has no other id. Very long texts are hashed whole, by one task each. Ties: a bit
    set in exactly half the hashes is 0; equal fingerprints are one node. Repeated rows are all
    returned. An empty table gives an empty result. Columns of ``df`` other than the two named are
    ignored, whatever their names.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("max_bits is 0 to 5: halves of the grid reach no further")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    entries = materialise(with_entry_ids(rows.mapInArrow(_fingerprint_entries(words), "fp long, ids array<long>")), "fingerprints")
    nodes = materialise(entries.groupBy("fp").agg(F.min(F.array_min("ids")).alias("first_id")), "nodes")
    reach, width = max_bits // 2, max(shuffle_width(df.sparkSession), 2)
    linked_in = lambda cells, large: cells.repartition(width, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_link_cells(max_bits, large), "a long, b long, cell long")
    found = materialise(linked_in(nodes.select("fp").mapInArrow(_cells(reach), "cell long, fp long"), large_cell), "links")
    again = found.where("cell IS NOT NULL").select("cell", F.col("a").alias("fp"))
    links = found.where("cell IS NULL").select("a", "b")
    if again.limit(1).count():
        links = links.unionByName(linked_in(again.mapInArrow(_cells_below(reach), "cell long, fp long"), None).select("a", "b"))
    roots = connected_components(links)
    linked = materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    firsts = materialise(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    of = linked.join(firsts, "root").select("fp", "component_id")
    classes = nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return (
        tell_entries(entries, classes, ["fp"])
        .select("fp", "component_id", F.explode("ids").alias("doc_id"))
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int | None = None) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their near-duplicate component.

    With ``max_bits`` texts are linked by their fingerprints. Without, those whose sets of shingles have
    a Jaccard similarity of 0.8 or more: ``near_duplicates`` at ``EXACT_BITS`` gives the first pairs, an
    exact check keeps those of 0.8 or more, and pairs whose fingerprints are farther apart come from a
    prefix join of the sets (``jaccard_dedup``), which compares what isn't linked yet. Rows with a null id stay. Of repeated rows (one
    id) all stay. Columns and their names are those of ``df``.
    """
    if max_bits is None:
        with small_batches(df.sparkSession):
            near = materialise(near_duplicates(df, id_col, text_col, words, EXACT_BITS).select("doc_id", "component_id"), "near-classes")
        return drop_similar_texts(df, id_col, text_col, words, near)
    found = near_duplicates(df, id_col, text_col, words, max_bits)
    gone = free_name(df, "gone_id")
    losers = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "losers")
    return df.join(losers, F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, max_bits=4)
