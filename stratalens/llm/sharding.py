"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

A group is the rows of one text. Its vector (bytes, tokens, rows, each as a share of what one shard
should hold) goes to the shard where the dot product with the residual capacity is highest, largest
groups first. The few groups that hold a notable share of the corpus (their number is bounded by the
definition) are placed first, on the driver. Only a group that fits in no shard as it is gets split: one
larger than a shard is dealt evenly to all, one that finds no room any more goes to the best shard as far
as that has room, and the rest goes on. Their rows learn their shard from a small table. All other groups
are dealt by hash; each deal is placed, as its groups come in order of size, against its share of the
capacity that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.common import documents, materialise, shuffle_width, text_or_empty

#: A group is large if it holds more than this part of a shard in any measure; at most three times shards * LARGE are.
LARGE = 64
#: A group that passes a shard's capacity by less than this part of a shard still fits.
SLACK = 0.002
#: What a shard has too much of a measure counts so many times as much as what it lacks.
OVER = 8
#: How much the measures weigh in the dot product: the law is about bytes.
WEIGHTS = np.array([16.0, 1.0, 1.0])
MEASURES = ("size", "tokens", "rows")


def place(vectors: np.ndarray, residual: np.ndarray, turn: int = 0) -> np.ndarray:
    """The shard of each vector, in the given order; ``residual`` (shards x measures) is used up. Ties go to the first shard from ``turn`` on."""
    out, many = np.empty(len(vectors), np.int32), len(residual)
    residual[:] = np.roll(residual, -turn, axis=0)
    worth = np.where(residual < 0, OVER * residual, residual) * WEIGHTS
    for i, v in enumerate(vectors):
        at = int(np.argmax(worth @ v))
        residual[at] -= v
        worth[at] = np.where(residual[at] < 0, OVER * residual[at], residual[at]) * WEIGHTS
        out[i] = (at + turn) % many
    residual[:] = np.roll(residual, turn, axis=0)
    return out


def place_large(vectors: np.ndarray, residual: np.ndarray) -> list[list[tuple[int, float]]]:
    """(shard, part of the group) for each vector, in the given order: one shard with the whole group if any has room for it. ``residual`` is used up."""
    out = []
    for v in vectors:
        if v.max() > 1 + SLACK:
            out.append([(at, 1 / len(residual)) for at in range(len(residual))])
            residual -= v / len(residual)
            continue
        own, left = [], 1.0
        while left > 0:
            part = v * left
            fits = (residual + SLACK >= part).all(axis=1)
            if fits.any():
                at = int(np.argmax(np.where(fits, residual @ part, -np.inf)))
                take = left
            else:
                room = np.where(part > 0, np.maximum(residual, 0) / np.where(part > 0, part, 1), np.inf).min(axis=1)
                at = int(np.argmax(room))
                take = left * min(float(room[at]), 1.0)
                if take < 1e-3:  # no room anywhere: rounding; the fullest measure decides no longer
                    at, take = int(np.argmax(residual @ part)), left
            own.append((at, take))
            residual[at] -= v * take
            left = left - take if take < left else 0.0
        out.append(own)
    return out


def _place_small(residual: np.ndarray, unit: np.ndarray, deals: int):
    """residual: what is left in each shard, in shards; unit: what one shard should hold. Groups come deal by deal, each largest first; a deal has an equal share of what is left."""
    schema = pa.schema([("group_a", pa.int64()), ("group_b", pa.int64()), ("shard", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, residual
        for batch in batches:
            deal, a, b, *measures = (c.to_numpy() for c in batch.columns)
            vectors = np.stack(measures, axis=1).astype(np.float64) / unit
            shard = np.empty(len(a), np.int32)
            starts = [0, *(np.flatnonzero(np.diff(deal)) + 1).tolist(), len(a)]
            for s, e in zip(starts[:-1], starts[1:]):
                if e > s and deal[s] != last:
                    last, own = deal[s], residual / deals
                shard[s:e] = place(vectors[s:e], own, int(last or 0) % len(residual))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, shard)], schema=schema)

    return run


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: sizes (UTF-8 bytes plus 1), tokens (words between white space) and rows of the
    shards are near equal. Rows with the same text share a shard, unless no shard has room for them
    all. Slots number each shard's rows from 0, without gaps; grown_shard is null.

    Nulls: a null text counts as empty; null ids are as good as others. Very long texts: one that is
    larger than a shard's share goes to one shard whole. Ties go to the shard with the lower number,
    counted from another one in each deal. Repeated rows are placed each. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark, text = df.sparkSession, text_or_empty(text_col)
    rows = materialise(
        df.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("group_a"),
            F.xxhash64(text, F.lit(1)).alias("group_b"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "sizes",
    )
    groups = rows.groupBy("group_a", "group_b").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sums = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    total = np.array([float(sums[m] or 0) for m in MEASURES])
    is_large = F.greatest(*(F.col(m) * F.lit(shards * LARGE / max(float(sums[m] or 0), 1.0)) for m in MEASURES)) > 1
    large = groups.where(is_large).orderBy("group_a", "group_b").collect()  # at most 3 * shards * LARGE

    unit = np.maximum(total, 1) / shards
    vectors = np.array([[g[m] for m in MEASURES] for g in large], np.float64).reshape(-1, len(MEASURES)) / unit
    order = np.argsort(-vectors.max(axis=1, initial=0), kind="stable")
    told_rows = []
    for n, own in zip(order.tolist(), place_large(vectors[order], np.ones((shards, len(MEASURES))))):
        ends = np.cumsum([part for _, part in own])
        told_rows.append((large[n].group_a, large[n].group_b, [s for s, _ in own], [*ends[:-1].tolist(), 1.0]))
    told = F.broadcast(spark.createDataFrame(told_rows, "group_a long, group_b long, parts array<int>, ends array<double>"))  # at most 3 * shards * LARGE rows

    own = ["doc_id", "size", "text_crc32", "tokens", "uid"]
    draw = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    nth = F.size(F.filter("ends", lambda end: end <= draw)) + 1
    first = rows.join(told, ["group_a", "group_b"]).select(*own, F.element_at("parts", F.least(nth, F.size("parts"))).alias("shard"))
    if large:  # what their rows really took
        took = {r.shard: r for r in first.groupBy("shard").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()}
        used = np.array([[float(took[s][m]) if s in took else 0.0 for m in MEASURES] for s in range(shards)])
    else:
        used = np.zeros((shards, len(MEASURES)))
    left, width = (total / shards - used) / unit, shuffle_width(spark)
    weight = F.greatest(*(F.col(m) / F.lit(float(u)) for m, u in zip(MEASURES, unit)))
    dealt = groups.where(~is_large).withColumn("deal", F.pmod("group_a", F.lit(width))).repartition(width, "deal").sortWithinPartitions("deal", weight.desc(), "group_a", "group_b")
    homes = dealt.select("deal", "group_a", "group_b", *MEASURES).mapInArrow(_place_small(left, unit, width), "group_a long, group_b long, shard int")
    rest = rows.join(told, ["group_a", "group_b"], "left_anti").join(homes, ["group_a", "group_b"]).select(*own, "shard")
    placed = materialise(first.unionByName(rest).withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "placed")

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "shard", "base")
    within = F.row_number().over(Window.partitionBy("part", "shard").orderBy("nth")) - 1
    return placed.withColumn("within", within).join(base, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=16)
