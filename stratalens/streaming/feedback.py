"""Feedback as a stream: events become familiarity, exactly once, in whatever order they come.

There is no watermark: sums and maxima take late events as they come, so the state is one row for each
memory, kept for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.adaptive import familiarity, merge_states, new_events
from stratalens.sources.tables import feedback_of


def familiarity_stream(events: DataFrame) -> DataFrame:
    """The running state of each memory, for output modes update and complete. ``events``: a stream of the events table."""
    return familiarity(feedback_of(events).dropDuplicates(["event_id"]))


def _read_or_empty(spark, path: str, schema) -> DataFrame:
    try:
        found = spark.read.schema(schema).parquet(path)
        found.limit(1).count()
        return found
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_to_log(events: DataFrame, log_path: str, state_path: str, checkpoint: str) -> int | None:
    """Append new feedback to a Parquet log (``log_path``/batch=N) and merge it into the state (``state_path``/batch=N); the last batch's number.

    A batch's events are those that no batch before it has; the state after it is the one before it and
    the batch's own, merged. So a batch that runs again overwrites both with the same, and only a row for
    each memory is read and written besides the batch and the log's keys.
    """
    spark = events.sparkSession
    done: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        rows = feedback_of(batch)
        log = _read_or_empty(spark, log_path, rows.schema.add("batch", "long")).where(F.col("batch") < number)
        new_events(log, rows).write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        own = familiarity(spark.read.schema(rows.schema).parquet(f"{log_path}/batch={number}"))
        before = _read_or_empty(spark, f"{state_path}/batch={number - 1}", own.schema) if number else spark.createDataFrame([], own.schema)
        merge_states(before, own).write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        done.append(number)

    query = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(done, default=None)


def run_available(events: DataFrame, folder: str) -> DataFrame:
    """Process what there is, then stop; the last state. A restart with the same folder goes on where it ended."""
    append_to_log(events, f"{folder}/log", f"{folder}/state", f"{folder}/checkpoint")
    states = events.sparkSession.read.parquet(f"{folder}/state")
    newest = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == newest).drop("batch")


def resume(checkpoint_state: DataFrame, tail: DataFrame) -> DataFrame:
    """A saved state and the events after it, as one."""
    return merge_states(checkpoint_state, familiarity(tail))


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "1 day") -> DataFrame:
    """Outcomes in windows of event time, for monitoring the log; late events are dropped past the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
