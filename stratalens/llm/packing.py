"""Best-fit packing of token sequences by exact-complement hashing.

All that the plan depends on is how many pieces there are of each length, at most ``max_len`` numbers,
however large the corpus. On these counts: a piece of length l leaves the gap max_len - l; an index of
the sums of single lengths, pairs and triples is asked for the gap, and each combination found is used
as often as the counts allow. Counts only fall, so a combination that has run out is passed over for
good. What no exact combination fills goes where the smallest gap still takes it (best fit, longest
first). The plan says, for each length,
which ranks of its pieces go to which sequences and offsets; pieces learn their rank from counts per
part and length, a small file for each part in the shared folder, so no length's pieces ever meet in one
task, and neither pieces nor their ids are shuffled.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.common import documents, materialise, new_path, small_batches, text_or_empty, trimmed
from stratalens.llm.tokens import encoder

#: Combinations of lengths, each with the copies of each length, and how often it is used.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def _times(lengths: Counter, stock: np.ndarray) -> int:
    """How often the stock gives this combination."""
    return min(int(stock[n]) // c for n, c in lengths.items())


class SumIndex:
    """The single lengths, pairs and triples in stock by their sum. A sum's combinations stand in a fixed order, and a mark says how many of them have run out."""

    def __init__(self, stock: np.ndarray) -> None:
        self.stock, most = stock, len(stock) - 1
        lengths = np.flatnonzero(stock)
        low, high = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        keep = (low <= high) & (low + high <= most)
        low, total = low[keep], (low + high)[keep]
        order = np.lexsort((low, total))
        #: Pairs by sum, then by their smaller length: the most even pair of a sum last.
        self.low = low[order].tolist()
        self.first = np.searchsorted(total[order], np.arange(most + 2)).tolist()
        self.pair_mark = self.first[:-1]
        #: A triple's sum is indexed by its first length, longest first, and the pairs of the rest.
        self.heads, self.triple_mark = lengths[::-1].tolist(), [0] * (most + 1)

    def _in_stock(self, a: int, b: int) -> bool:
        return self.stock[a] > (a == b) and self.stock[b] > 0

    def single(self, gap: int, taken: Counter) -> Counter | None:
        found = taken + Counter((gap,))
        return found if _times(found, self.stock) > 0 else None

    def pairs_left(self, gap: int) -> range:
        """Places of the pairs of a sum from the first that is still in stock on."""
        at, end = self.pair_mark[gap], self.first[gap + 1]
        while at < end and not self._in_stock(self.low[at], gap - self.low[at]):
            at += 1
        self.pair_mark[gap] = at
        return range(at, end)

    def pair(self, gap: int, taken: Counter) -> Counter | None:
        for at in self.pairs_left(gap):
            a = self.low[at]
            if self._in_stock(a, gap - a):
                found = taken + Counter((a, gap - a))
                if _times(found, self.stock) > 0:
                    return found
        return None

    def triple(self, gap: int, taken: Counter) -> Counter | None:
        over = True  # all before have run out
        for at in range(self.triple_mark[gap], len(self.heads)):
            a = self.heads[at]
            if a < gap and self.stock[a] > 0 and self.pairs_left(gap - a):
                over = False
                if found := self.pair(gap - a, taken + Counter((a,))):
                    return found
            elif over:
                self.triple_mark[gap] = at + 1
        return None

    def fillers(self, length: int, gap: int, size: int) -> Counter | None:
        """A piece of this length and ``size`` more that fill the gap it leaves exactly; all in stock together."""
        return (self.single, self.pair, self.triple)[size - 1](gap, Counter((length,)))


def plan_packing(counts: dict[int, int], max_len: int) -> Plan:
    """The plan for the given numbers of pieces by length (1 to ``max_len``)."""
    stock = np.zeros(max_len + 1, np.int64)
    for n, c in counts.items():
        stock[n] += c
    plan: Plan = []

    def use(lengths: Counter, times: int) -> None:
        plan.append((tuple(sorted(lengths.items(), reverse=True)), times))
        for n, c in lengths.items():
            stock[n] -= c * times

    if stock[max_len]:
        use(Counter((max_len,)), int(stock[max_len]))
    sums = SumIndex(stock)
    for size in (1, 2, 3):
        for length in range(max_len - 1, 0, -1):
            while stock[length] and (found := sums.fillers(length, max_len - length, size)):
                use(found, _times(found, stock))

    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by gap
    for length in range(max_len - 1, 0, -1):
        left = int(stock[length])
        while left:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                many = max_len // length
                bins, over = divmod(left, many)
                if bins:
                    open_bins.setdefault(max_len - many * length, []).append((((length, many),), bins))
                if over:
                    open_bins.setdefault(max_len - over * length, []).append((((length, over),), 1))
                break
            what, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            used = min(bins, left)
            if used < bins:
                open_bins.setdefault(gap, []).append((what, bins - used))
            more = (*what[:-1], (length, what[-1][1] + 1)) if what[-1][0] == length else (*what, (length, 1))
            open_bins.setdefault(gap - length, []).append((more, used))
            left -= used
    for group in open_bins.values():
        plan += group
    return plan


def lay_out(plan: Plan) -> dict[str, np.ndarray]:
    """For each length a run of ranks: key (length << 40 | first rank), copies in a sequence, first sequence, offset of the first copy."""
    rows, next_rank, sequence = [], Counter(), 0
    for what, times in plan:
        offset = 0
        for length, copies in what:
            rows.append((length << 40 | next_rank[length], copies, sequence, offset))
            next_rank[length] += copies * times
            offset += length * copies
        sequence += times
    key, copies, first, offset = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4
    return {"key": key, "copies": copies, "first": first, "offset": offset}


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: the first may be shorter."""
    first = n % max_len or min(n, max_len)
    return [(0, first), *((at, max_len) for at in range(first, n, max_len))]


_PIECE = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


#: Pieces of text that a worker's encoder keeps, and rows that it gathers for a batch, where the ids themselves are wanted: sequences of ids take the room.
KNOWN_WITH_IDS, ROWS_WITH_IDS = 100_000, 500


def _pieces(path: str, max_len: int, end_id: int, with_ids: bool):
    fields = [("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path, KNOWN_WITH_IDS) if with_ids else encoder(path)
        encode_many, end, part = own_encoder.encode_many, np.array([end_id], np.uint32).tobytes(), TaskContext.get().partitionId()
        met: Counter = Counter()
        rows: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode_many(batch.column(1).to_pylist())):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, max_len)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (part, doc, piece, start, length, zlib.crc32(own), met[length])
                    rows.append((*row, np.frombuffer(own, np.uint32).astype(np.int32)) if with_ids else row)
                    met[length] += 1
                if len(rows) > (ROWS_WITH_IDS if with_ids else 5_000):
                    yield give()
                    rows = []
        if rows:
            yield give()

    return run


def _write_bases(folder: str, max_len: int):
    """For each part a file: how many pieces of each length (0 to ``max_len``) the parts before have. Rows: part, length, base, ascending by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for part, own in groupby(rows, key=itemgetter(0)):
            base = np.zeros(max_len + 1, "<i8")
            for _, length, n in own:
                base[length] = n
            attempt = f"{root}/_{uuid.uuid4().hex}"
            with system.open_output_stream(attempt) as out:
                out.write(base.tobytes())
            system.move(attempt, f"{root}/{part}")  # whole or not at all, even if two attempts write it
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    return run


@lru_cache(maxsize=8)
def _bases(folder: str, part: int) -> np.ndarray:
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{root}/{part}") as file:
        return np.frombuffer(file.read(), "<i8")


def _place(layout, folder: str):
    """Sequence and offset of pieces; a function of short columns, so that ids stay where they are."""

    def run(part: pa.Array, length: pa.Array, nth: pa.Array) -> pa.Array:
        x, part, length, rank = layout.value, part.to_numpy(), length.to_numpy(), nth.to_numpy().copy()
        for p in np.unique(part).tolist():
            own = part == p
            rank[own] += _bases(folder, p)[length[own]]
        at = np.searchsorted(x["key"], length << 40 | rank, side="right") - 1
        nth = rank - (x["key"][at] & ((1 << 40) - 1))
        sequence, offset = x["first"][at] + nth // x["copies"][at], x["offset"][at] + length * (nth % x["copies"][at])
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return F.arrow_udf(run, "sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is the ids of its whole text and then ``end_id``. A document of more than ``max_len``
    tokens is cut into pieces of ``max_len``, of which the first may be shorter; others are one piece.
    Sequences hold ``max_len`` tokens at most, without gaps between pieces. What is sent to all tasks
    is bounded by ``max_len``, not by the corpus.

    Nulls: a null text is an empty document, one token long; a null id is returned as it is. Very long
    texts are encoded whole, by one task each. Ties: pieces of one length are alike; they are dealt in
    the order of reading. Repeated rows are packed each. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    extra = ", ids array<int>" * with_ids
    cut_up = _pieces(tokenizer_path, max_len, end_id, with_ids)
    if with_ids:
        with small_batches(spark):
            pieces = materialise(rows.mapInArrow(trimmed(cut_up), _PIECE + extra), "pieces")
    else:
        pieces = materialise(rows.mapInArrow(cut_up, _PIECE + extra), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    stock = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    layout = spark.sparkContext.broadcast(lay_out(plan_packing(stock, max_len)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    folder = new_path(spark, "bases")
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    base.repartition("part").sortWithinPartitions("part").mapInArrow(_write_bases(folder, max_len), "part int").count()
    placed = pieces.withColumn("at", _place(layout, folder)("part", "length", "nth"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "at.sequence_id", "at.offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, end_id=0)
