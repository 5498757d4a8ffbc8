"""Full-text search: postings, BM25 and the lexical channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.text import tokens
from stratalens.operators.filters import lexical_match
from stratalens.operators.ranking import ranked
from stratalens.sources.store import settled

K1, B = 1.2, 0.75


#: Postings are stored by this many buckets of their term's hash.
BUCKETS = 64


@dataclass
class LexicalIndex:
    """A stored full-text index.

    ``postings`` (space_id, memory_id, term, tf, length, segment, bucket) lie by segment and bucket, and
    within a file by term, so that a query reads only its terms; ``spaces`` (space_id, documents, tokens,
    segment) has a row for each space. A space is replaced by a later segment; the newest one holds.
    """

    postings: DataFrame
    spaces: DataFrame

    def current(self) -> DataFrame:
        return self.spaces.groupBy("space_id").agg(F.max("segment").alias("segment"), *(F.max_by(c, "segment").alias(c) for c in ("documents", "tokens")))


def postings(records: DataFrame) -> DataFrame:
    """(space_id, memory_id, term, tf, length): exploded once, counted by document and term."""
    words = records.select("space_id", "memory_id", tokens(F.col("text")).alias("words"))
    each = words.select("space_id", "memory_id", F.size("words").cast("long").alias("length"), F.explode("words").alias("term"))
    return each.groupBy("space_id", "memory_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def write_index(records: DataFrame, path: str, segment: int = 0) -> None:
    """Write the records' spaces as one segment of the index at ``path``."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    rows = postings(records).withColumn("bucket", bucket)
    rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings/segment={segment}")
    sizes = records.select("space_id", F.size(tokens(F.col("text"))).cast("long").alias("n")).groupBy("space_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))
    sizes.write.mode("overwrite").parquet(f"{path}/spaces/segment={segment}")  # last: a segment without it isn't there


def update_index(records: DataFrame, path: str) -> int:
    """Replace the index of the records' spaces by a new segment; its number."""
    segment = records.sparkSession.read.parquet(f"{path}/spaces").agg(F.max("segment")).first()[0] + 1
    write_index(records, path, segment)
    return segment


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/spaces"))


def _terms(spark: SparkSession, query: str) -> list[tuple[str, int]]:
    """The query's terms and their buckets."""
    words = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("w"))
    return [(r.w, r.b) for r in words.select("w", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).collect()]


def bm25_indexed(index: LexicalIndex, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(space_id, memory_id, score) of the documents with any query term, from the postings of these terms alone.

    A score is added up in the order of the query's terms, however the postings lie: texts alike in all
    that counts get the same score to the last bit, so that their order is that of their ids.
    """
    spark = index.postings.sparkSession
    wanted, current = _terms(spark, query), index.current()
    total = current.agg(F.sum("documents").cast("double").alias("n"), F.sum("tokens").cast("double").alias("tokens")).first()
    n, mean = total.n or 0.0, (total.tokens or 0.0) / (total.n or 1.0) or 1.0
    hits = index.postings.where(F.col("bucket").isin([x for _, x in wanted]) & F.col("term").isin([w for w, _ in wanted]))
    hits = hits.join(current.select("space_id", "segment"), ["space_id", "segment"])
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    hits = hits.join(F.broadcast(df), "term")  # a row for each term of the query
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    share = idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("length") / F.lit(mean)))
    shares = hits.groupBy("space_id", "memory_id").agg(F.max(F.lit(0.0)).alias("none"), *(F.sum(F.when(F.col("term") == w, share)).alias(f"share{i}") for i, (w, _) in enumerate(wanted)))
    return shares.select("space_id", "memory_id", sum((F.coalesce(f"share{i}", F.lit(0.0)) for i in range(len(wanted))), F.col("none")).alias("score"))


def term_counts(records: DataFrame) -> DataFrame:
    """(term, df, occurrences): exploded once and pre-aggregated before the shuffle."""
    per_doc = records.select("memory_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("memory_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def _times(words: str, term: str):
    """How often an array has a term, without a lambda."""
    return F.size(words) - F.size(F.array_remove(words, term))


def bm25(records: DataFrame | LexicalIndex, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(space_id, memory_id, score) of the records with any query term, by their index or, without one, by a scan that only the query's terms leave."""
    if isinstance(records, LexicalIndex):
        return bm25_indexed(records, query, k1, b)
    spark = records.sparkSession
    wanted = [w for w, _ in _terms(spark, query)]
    words = records.select("space_id", "memory_id", tokens(F.col("text")).alias("words"))
    counted = words.select("space_id", "memory_id", F.size("words").cast("double").alias("length"), *(_times("words", t).cast("double").alias(f"tf{i}") for i, t in enumerate(wanted)))
    counted = settled(counted, "term-counts")  # texts are cut into tokens once, for the totals and for the scores
    totals = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(wanted)))).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n, df, tf = totals.n, totals[f"df{i}"] or 0.0, F.col(f"tf{i}")
        idf = F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("length") / F.lit(totals.mean or 1.0)))
    hit = F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"tf{i}") for i in range(len(wanted)))) > 0
    return counted.where(hit).select("space_id", "memory_id", score.alias("score"))


def bm25_top_k(records: DataFrame | LexicalIndex, query: str, spaces: list[str], k: int) -> DataFrame:
    """The corpus' statistics, the scope's best: score descending, memory ascending."""
    return bm25(records, query).where(F.col("space_id").isin(spaces)).orderBy(F.desc("score"), "memory_id", "space_id").limit(k)


def lexical_channel(records: DataFrame, cues: list[str], spaces: list[str], limit: int, max_results: int, index: LexicalIndex | None = None, **constraints) -> DataFrame:
    """BM25 hits of the joined cues that hold a cue as it stands. ``evidence_rank`` counts before that test, ``rank`` after; both from 0."""
    hits = ranked(bm25_top_k(index or records, " ".join(cues), spaces, limit), [F.desc("score"), F.col("memory_id"), F.col("space_id")], "evidence_rank")
    kept = F.broadcast(hits).join(records.where(lexical_match(spaces, cues, **constraints)), ["space_id", "memory_id"])
    return ranked(kept.orderBy("evidence_rank").limit(max_results), [F.col("evidence_rank")], "rank")
