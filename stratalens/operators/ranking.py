"""Ranks: of short, already limited lists, within groups, and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.sources.store import working_path


def ranked(top: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number a list from 0. For the output of a limit only: its few rows are in one partition anyway."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group, ranked from 0; tasks keep no more than k of a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col(name) < k)


def ranked_whole(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number a table of any length from 0: sorted parts by range, written once, and the counts of the parts before."""
    path = working_path(df.sparkSession, "ranked")
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = rows.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")  # a row for each part
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
