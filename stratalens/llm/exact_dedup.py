"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition (a leaf) turns its rows into sorted runs: an entry for each digest, with the
identifiers that have it. Runs travel as chunks, sorted stretches of bounded length. Nodes are numbered
in base 2, a leaf begins at node (leaf modulo nodes). In round ``r`` the nodes that differ only in bit
``r`` exchange entries, each keeping the digests whose own bit ``r`` is its own, and merge what they
hold and receive, many runs at a time: chunks come in the order of their first keys, and an entry
leaves once no later chunk can begin before it, so a task holds one chunk of each open run and nothing
is sorted anew. After log2 n rounds node ``n`` has the one merged run of the digests that belong to
``n``. A merged run has a digest once, with the identifier that stays, so a text that a third of all
rows share costs one entry per leaf and round, wherever it is.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import documents, materialise, shuffle_width, tell_entries, text_or_empty, with_entry_ids

#: Rows that a leaf gathers before it writes a run, identifiers in an entry and entries in a chunk at most.
RUN_ROWS, ENTRY_IDS, CHUNK = 200_000, 1_000, 2_000
#: An entry in a chunk: key (digest, probe and size of the text), whether an identifier stays, that one, its ordinal, rows.
_PACKED = struct.Struct(">48sBqqq")

_ENTRY = "leaf long, digest binary, probe long, size long, ids array<long>, ords array<long>, best long, best_ord long, n long"
_RUN = "digest binary, probe long, size long, keep_id long, keep_ord long, group_size long"
_CHUNK = "node int, first binary, entries binary"
_ENTRY_ARROW = pa.schema([("leaf", pa.int64()), ("digest", pa.binary()), ("probe", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("ords", pa.list_(pa.int64())), ("best", pa.int64()), ("best_ord", pa.int64()), ("n", pa.int64())])
_RUN_ARROW = pa.schema([("digest", pa.binary()), ("probe", pa.int64()), ("size", pa.int64()), ("keep_id", pa.int64()), ("keep_ord", pa.int64()), ("group_size", pa.int64())])
_CHUNK_ARROW = pa.schema([("node", pa.int32()), ("first", pa.binary()), ("entries", pa.binary())])

_MASK = (1 << 64) - 1


def _key(digest: bytes, probe: int, size: int) -> bytes:
    return digest + (probe & _MASK).to_bytes(8, "big") + size.to_bytes(8, "big")


def _better(a: tuple, b: tuple, largest: bool) -> tuple:
    """The (id, ordinal) that stays: a null id loses; of equal ids the lower ordinal wins."""
    if a[0] is None or b[0] is None:
        if a[0] is None and b[0] is None:
            return min(a, b, key=lambda x: x[1])
        return b if a[0] is None else a
    if a[0] == b[0]:
        return a if a[1] <= b[1] else b
    return a if (a[0] > b[0]) == largest else b


def _leaf_runs(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId()
        ordinal, held, groups = leaf << 33, 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in _ENTRY_ARROW]
            for (digest, probe, size), (ids, ords) in sorted(groups.items(), key=lambda x: _key(*x[0])):
                for at in range(0, len(ids), ENTRY_IDS):
                    some, some_ords = ids[at : at + ENTRY_IDS], ords[at : at + ENTRY_IDS]
                    best = (some[0], some_ords[0])
                    for x in zip(some[1:], some_ords[1:]):
                        best = _better(best, x, largest)
                    for col, v in zip(cols, (leaf, digest, probe, size, some, some_ords, *best, len(some))):
                        col.append(v)
            for at in range(0, len(cols[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], f.type) for c, f in zip(cols, _ENTRY_ARROW)], schema=_ENTRY_ARROW)

        for batch in batches:
            for doc, digest, probe, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, ords = groups.setdefault((digest, probe, size), ([], []))
                ids.append(doc)
                ords.append(ordinal)
                ordinal += 1
                held += 1
            if held >= RUN_ROWS:
                yield from flush()
                groups.clear()
                held = 0
        yield from flush()

    return run


class _Outbox:
    """Sorted entries on their way to nodes, as chunks."""

    def __init__(self, nodes: int) -> None:
        self.nodes, self.open, self.ready = nodes, {}, []

    def add(self, node: int, bit: int, entry: tuple) -> None:
        """Send an entry to the one of ``node`` and its partner of round ``bit`` that keeps it."""
        home = int.from_bytes(entry[0][32:40], "big") % self.nodes
        dest = node & ~(1 << bit) | home & 1 << bit
        own = self.open.setdefault(dest, [])
        own.append(entry)
        if len(own) >= CHUNK:
            self.close(dest)

    def close(self, dest: int | None = None) -> None:
        """End the chunk of one node, or of all."""
        for d in list(self.open) if dest is None else [dest]:
            own = self.open.pop(d)
            self.ready.append((d, own[0][0], b"".join(_PACKED.pack(k, best is not None, best or 0, o, n) for k, best, o, n in own)))

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.ready) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.ready), _CHUNK_ARROW)], schema=_CHUNK_ARROW)
            self.ready = []


def _leaf_chunks(nodes: int):
    """Chunks of the leaves' runs, on their way to the nodes of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = _Outbox(nodes), None
        for batch in batches:
            for leaf, digest, probe, size, best, best_ord, n in zip(*(c.to_pylist() for c in batch.columns)):
                key = _key(digest, probe, size)
                if last is not None and (leaf, key) < last or last and leaf != last[0]:  # another run
                    out.close()
                last = leaf, key
                out.add(leaf % nodes, 0, (key, best, best_ord, n))
            yield from out.take(50)
        out.close()
        yield from out.take()

    return run


def _unpacked(packed: bytes) -> Iterator[tuple]:
    for key, known, best, best_ord, n in _PACKED.iter_unpack(packed):
        yield key, best if known else None, best_ord, n


def merged_runs(chunks: Iterator[tuple[bytes, bytes]], largest: bool) -> Iterator[tuple]:
    """One run, each key once, of chunks (first key, packed entries) that come in the order of their first keys."""
    heap: list[tuple] = []  # next entry's key, number of the chunk, the entry, the chunk's others
    state = None

    def out(before: bytes | None) -> Iterator[tuple]:
        while heap and (before is None or heap[0][0] < before):
            _, number, entry, others = heap[0]
            yield entry
            following = next(others, None)
            if following is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (following[0], number, following, others))

    def every() -> Iterator[tuple]:
        for number, (first, packed) in enumerate(chunks):
            yield from out(first)
            others = _unpacked(packed)
            entry = next(others)
            heapq.heappush(heap, (entry[0], number, entry, others))
        yield from out(None)

    for key, best, best_ord, n in every():
        if state is not None and state[0] == key:
            state = (key, *_better(state[1:3], (best, best_ord), largest), state[3] + n)
        else:
            if state is not None:
                yield state
            state = key, best, best_ord, n
    if state is not None:
        yield state


def _merge(largest: bool, nodes: int, next_bit: int | None):
    """Merge what a node has of a round; chunks for the next one, or after the last the merged run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list[int] = []  # the node: a partition has one

        def chunks() -> Iterator[tuple[bytes, bytes]]:
            for batch in batches:
                for node, first, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    at[:] = [node]
                    yield first, packed

        out, rows = _Outbox(nodes), []
        for entry in merged_runs(chunks(), largest):
            if next_bit is not None:
                out.add(at[0], next_bit, entry)
                yield from out.take(50)
                continue
            key, best, best_ord, n = entry
            probe = int.from_bytes(key[32:40], "big")
            rows.append((key[:32], probe - (1 << 64) if probe >> 63 else probe, int.from_bytes(key[40:], "big"), best, best_ord, n))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN_ARROW)], schema=_RUN_ARROW)
                rows = []
        out.close()
        yield from out.take()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN_ARROW)], schema=_RUN_ARROW)

    return run


def tree_shape(width: int) -> tuple[int, int]:
    """(nodes, rounds): the most nodes that ``width`` partitions hold, a power of two, and its logarithm; one round at least."""
    rounds = max(1, width.bit_length() - 1)
    return 1 << rounds, rounds


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with the same text form a group; ``keep`` names the identifier that stays, ``largest`` or
    ``smallest``. Two texts are the same when SHA-256, XXH64 and length all agree.

    Nulls: a null text counts as the empty text; a null id never wins against another id. Very long
    texts are hashed whole, inside the JVM; only digests travel. Ties and repeated rows (same id and
    text): all are returned, one of them is ``kept``, the first in the order of reading. An empty table
    gives an empty result. Columns of ``df`` other than the two named are ignored, whatever their names.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest, spark = keep == "largest", df.sparkSession
    text = text_or_empty(text_col)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("probe"), F.octet_length(text).cast("long").alias("size"))
    entries = materialise(with_entry_ids(rows.mapInArrow(_leaf_runs(largest), _ENTRY)), "digest-runs")

    nodes, rounds = tree_shape(shuffle_width(spark))
    runs = entries.select("leaf", "digest", "probe", "size", "best", "best_ord", "n").mapInArrow(_leaf_chunks(nodes), _CHUNK)
    for r in range(rounds):
        last = r + 1 == rounds
        met = runs.repartitionById(nodes, "node").sortWithinPartitions("node", "first")  # chunks, not entries
        runs = met.mapInArrow(_merge(largest, nodes, None if last else r + 1), _RUN if last else _CHUNK)
    merged = runs
    return (
        tell_entries(entries.select("entry", "digest", "probe", "size", "ids", "ords"), merged, ["digest", "probe", "size"])
        .select("digest", "keep_id", "keep_ord", "group_size", F.explode(F.arrays_zip("ids", "ords")).alias("row"))
        .select(F.col("row.ids").alias("doc_id"), "keep_id", "group_size", (F.col("row.ords") == F.col("keep_ord")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
