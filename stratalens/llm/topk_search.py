"""Exact top-k search by distributed histogram selection.

Scores are integers. For a block of queries, every task scores all its rows and counts, for each query,
how many scores fall into each bin; the counts are added and the bin that holds the k-th highest score
is found. The next round counts only within that bin, ten bits further, until the k-th score is known
exactly. Then one more pass keeps the scores above it and, of those equal to it, the smallest ids.

A task's histogram for a query goes out only down to its own k-th score: the k-th of all can't be
lower. Queries come in blocks of bounded size (``BLOCK_BYTES``), each sent to all tasks; vectors that
equal each other by the thousand cost no more than others, as no task keeps more than k for a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of the query vectors that are sent to all tasks at once, at most about twice this, and queries.
BLOCK_BYTES, BLOCK_QUERIES = 16_000_000, 4_096
BIN_BITS = 10
#: Scores that a task holds at a time.
CELLS = 1_000_000


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double."""
    return np.floor(values.astype(np.float64) * scale)


class Block:
    """Queries that are answered together, by their vectors' length."""

    def __init__(self, ids: list[int], vectors: list[list[float]], scale: int) -> None:
        self.ids = np.array(ids, np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(v) for v in vectors])
        for n in np.unique(sizes).tolist():
            who = np.flatnonzero(sizes == n)
            self.by_size[n] = who, integers(np.array([vectors[i] for i in who]), scale)
        self.longest = max((float((m * m).sum(axis=1).max()) for _, m in self.by_size.values()), default=0.0)

    def scored(self, batches: Iterator[pa.RecordBatch], scale: int, lift: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, row ids, lifted scores as rows x queries, mask of a query's own rows), block by block."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            sizes = np.diff(ends)
            for n, (who, matrix) in self.by_size.items():
                rows = np.flatnonzero(sizes == n)
                step = max(1, CELLS // len(who))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    vectors = integers(flat[ends[some][:, None] + np.arange(n)], scale)
                    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * n
                    score = vectors @ matrix.T if largest < 2**53 else vectors.astype(np.int64) @ matrix.astype(np.int64).T
                    own = ids[some][:, None] == self.ids[who][None, :] if np.isin(ids[some], self.ids[who]).any() else None
                    yield who, ids[some], score.astype(np.int64).view(np.uint64) + np.uint64(lift), own


_COUNT = pa.schema([("query", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
_HIT = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _histograms(block, state, scale: int, lift: int, shift: int):
    """Counts of the bins of ``BIN_BITS`` bits from ``shift`` on, for scores with the prefix found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (prefix, need) = block.value, state.value
        width, many = 1 << BIN_BITS, len(queries.ids)
        counts = np.zeros(many * width, np.int64)
        for who, _, lifted, own in queries.scored(batches, scale, lift):
            bins = lifted >> np.uint64(shift)
            ok = (bins >> np.uint64(BIN_BITS)) == prefix[who][None, :]
            if own is not None:
                ok &= ~own
            flat = (bins & np.uint64(width - 1)).astype(np.int64) + (who * width)[None, :]
            counts += np.bincount(flat[ok], minlength=many * width)
        table = counts.reshape(many, width)[:, ::-1]
        above = np.cumsum(table, axis=1) - table
        query, place = np.nonzero((table > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array((width - 1 - place).astype(np.int32)), pa.array(table[query, place])], schema=_COUNT)

    return run


def _hits(block, state, scale: int, lift: int, k: int):
    """Scores not under the k-th, at most k for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = block.value, state.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            query, ids, lifted = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ids, ~lifted, query))
            query, ids, lifted = query[order], ids[order], lifted[order]
            start = np.searchsorted(query, query)
            top = np.arange(len(query)) - start < k
            return query[top], ids[top], lifted[top]

        size = 0
        for who, ids, lifted, own in queries.scored(batches, scale, lift):
            ok = lifted >= least[who][None, :]
            if own is not None:
                ok &= ~own
            row, column = np.nonzero(ok)
            held.append((who[column], ids[row], lifted[row, column]))
            size += len(row)
            if size > CELLS:
                held = [best()]
                size = len(held[0][0])
        if held:
            query, ids, lifted = best()
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids), pa.array((lifted - np.uint64(lift)).view(np.int64))], schema=_HIT)

    return run


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of the highest inner product with each query.

    Components become floor(scale * x), x as double; the score is the integer inner product, of
    vectors of the same length. A query is a row where ``is_query`` (of ``df``'s columns) holds; its
    candidates are all rows whose id is another. Equal scores: the smaller id comes first. Fewer than
    ``k`` candidates: all are returned.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part.
    Repeated rows are candidates each, and queries each. Scores are exact to 64 bits; beyond that
    they wrap. An empty table or no query gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    sound = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is greater than infinity
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", sound))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    facts = rows.agg(F.max(length).alias("longest"), F.sum(F.col("q").cast("int")).alias("queries"), F.max(F.size("v")).alias("size")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts.queries:
        return spark.createDataFrame([], schema)
    per_block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * facts.size)))
    blocks = math.ceil(facts.queries / per_block)
    candidates = rows.select("id", "v")
    found = []
    for b in range(blocks):
        own = rows.where("q")
        if blocks > 1:  # by id: about per_block each
            own = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        own = own.select("id", "v").collect()
        if not own:
            continue
        block = Block([r.id for r in own], [r.v for r in own], scale)
        share = spark.sparkContext.broadcast(block)
        bound = int(math.sqrt(block.longest) * math.sqrt(facts.longest) * (1 + 1e-9)) + 2
        lift = min(bound, 2**63)
        rounds = math.ceil(min(2 * lift + 1, 2**64 - 1).bit_length() / BIN_BITS)
        prefix, need = np.zeros(len(own), np.uint64), np.full(len(own), k, np.int64)
        for level in range(rounds):
            state = spark.sparkContext.broadcast((prefix, need))
            shift = BIN_BITS * (rounds - 1 - level)
            counts = candidates.mapInArrow(_histograms(share, state, scale, lift, shift), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
            wanted = F.element_at(F.lit([int(x) for x in need]), F.col("query") + 1) if len(set(need.tolist())) > 1 else F.lit(int(need[0]))
            down = Window.partitionBy("query").orderBy(F.desc("bin"))
            at = counts.withColumn("upto", F.sum("n").over(down)).withColumn("need", wanted).where("upto >= need and upto - n < need").select("query", "bin", "upto", "n").collect()
            prefix, bins = prefix << np.uint64(BIN_BITS), {r.query: r for r in at}
            for query in range(len(own)):
                if query in bins:
                    prefix[query] |= np.uint64(bins[query].bin)
                    need[query] -= bins[query].upto - bins[query].n
                else:  # fewer than k candidates: all count
                    prefix[query] = 0
        least = spark.sparkContext.broadcast(prefix)
        name = spark.createDataFrame([(i, r.id) for i, r in enumerate(own)], "query int, query_id long")  # one block's
        hits = candidates.mapInArrow(_hits(share, least, scale, lift, k), "query int, vec_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(top.join(F.broadcast(name), "query").select("query_id", "rank", "vec_id", "score"))
    return reduce(DataFrame.unionAll, found)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(table, F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
