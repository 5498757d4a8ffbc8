"""Builds and providers: job states, retries, coverage, leases, garbage, and reuse by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds before the next attempt, and attempts at most.
DELAYS, ATTEMPTS = (1, 5, 30, 120, 600), 5


def after_failure(jobs: DataFrame, now: Column | int) -> DataFrame:
    """Running jobs that failed: queued again after a delay, or failed for good."""
    now = now if isinstance(now, Column) else F.lit(now)
    tries = F.col("attempts") + 1
    again = tries < ATTEMPTS
    delay = F.element_at(F.array(*(F.lit(d) for d in DELAYS)), F.least(tries, F.lit(len(DELAYS))).cast("int"))
    failed = F.col("state") == "running"
    return jobs.withColumns(
        {
            "attempts": F.when(failed, tries).otherwise(F.col("attempts")),
            "not_before": F.when(failed & again, now + delay).otherwise(F.col("not_before")),
            "state": F.when(failed, F.when(again, "queued").otherwise("failed")).otherwise(F.col("state")),
        }
    )


def reopened(jobs: DataFrame) -> DataFrame:
    """What ran when the store closed waits again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def superseded(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """Results whose input is no longer the memory's: (memory_id, input_hash) of jobs against the heads'."""
    now = heads.select("memory_id", F.col("input_hash").alias("_now"))
    return jobs.join(now, "memory_id", "left").withColumn("state", F.when(F.col("_now").isNull() | (F.col("_now") != F.col("input_hash")), "superseded").otherwise(F.col("state"))).drop("_now")


def coverage(pending: DataFrame, generation: int) -> int:
    """The last generation up to which nothing is pending."""
    first = pending.where(F.col("pending") > 0).agg(F.min("generation").alias("g")).first().g
    return generation if first is None else min(generation, first - 1)


def garbage(artifacts: DataFrame, roots: DataFrame, now: int, grace: int) -> DataFrame:
    """Artifacts that no root (serving, lease or pin that still holds) names and that are older than the grace."""
    live = roots.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("artifact").distinct()
    return artifacts.where(F.col("created_at") <= now - grace).join(live, "artifact", "left_anti")


def reusable(wanted: DataFrame, payloads: DataFrame) -> DataFrame:
    """(…, payload): what is already computed for an input hash; the rest has null."""
    return wanted.join(payloads.select("input_hash", "payload").dropDuplicates(["input_hash"]), "input_hash", "left")


def receipts(results: DataFrame, retrieval: str, now: int, ttl: int = 900) -> DataFrame:
    """The results of a query as receipts, which feedback refers to until they expire."""
    return results.withColumns({"retrieval_id": F.lit(retrieval), "result_id": F.concat_ws(":", F.lit(retrieval), "space_id", "memory_id", "revision_id"), "expires_at": F.lit(now + ttl)})


def resolve_receipts(receipts: DataFrame, feedback: DataFrame, now: int) -> DataFrame:
    """Feedback (result_id, outcome) with what it is about, and why it is refused where it is: unknown, expired or duplicate."""
    times = feedback.groupBy("result_id").agg(F.count(F.lit(1)).alias("times"))
    known = receipts.select("result_id", "space_id", "memory_id", "revision_id", "expires_at")
    joined = feedback.join(times, "result_id").join(known, "result_id", "left")
    refused = F.when(F.col("expires_at").isNull(), "unknown").when(F.col("expires_at") <= now, "expired").when(F.col("times") > 1, "duplicate")
    return joined.withColumn("refused", refused).drop("times", "expires_at")


def claimed(jobs: DataFrame, worker: str, now: int, many: int, denied: DataFrame | None = None) -> DataFrame:
    """The jobs with the next ``many`` queued ones given to a worker: what waits for nothing, by its time and number. Jobs of spaces that ``denied`` (space_id) names stay."""
    ready = jobs.where((F.col("state") == "queued") & (F.coalesce("not_before", F.lit(0)) <= now))
    if denied is not None:
        ready = ready.join(denied, "space_id", "left_anti")
    chosen = ready.orderBy(F.coalesce("not_before", F.lit(0)), "job").limit(many).select("job", F.lit(True).alias("_taken"))
    told = jobs.join(F.broadcast(chosen), "job", "left")  # many rows
    taken = F.col("_taken").isNotNull()
    return told.withColumn("state", F.when(taken, "running").otherwise(F.col("state"))).withColumn("worker", F.when(taken, worker)).select(*jobs.columns, "worker")


def acquire(leases: DataFrame, manifest: int, holder: str, now: int, seconds: int) -> DataFrame:
    """The leases with one more, less those that have run out."""
    return live_leases(leases, now).unionByName(leases.sparkSession.createDataFrame([(manifest, holder, now + seconds)], leases.schema))


def renew(leases: DataFrame, holder: str, now: int, seconds: int) -> DataFrame:
    """A holder's leases that still hold, from now on; one that has run out isn't renewed."""
    alive = live_leases(leases, now)
    return alive.withColumn("expires_at", F.when(F.col("holder") == holder, F.lit(now + seconds)).otherwise(F.col("expires_at")))


def release(leases: DataFrame, holder: str) -> DataFrame:
    return leases.where(F.col("holder") != holder)


def live_leases(leases: DataFrame, now: int) -> DataFrame:
    return leases.where(F.col("expires_at") > now)


def cached(entries: DataFrame, now: int, most: int) -> DataFrame:
    """Entries (key, used_at, expires_at) that a cache still has: not run out, and of these the ``most`` used last."""
    return entries.where(F.col("expires_at") > now).orderBy(F.desc("used_at"), "key").limit(most)


def published(results: DataFrame, heads: DataFrame, records: DataFrame) -> DataFrame:
    """Records with the tags that enrichment has found: only results whose input is still the head's count, those of others are dropped."""
    fresh = results.join(heads.select("memory_id", "input_hash"), ["memory_id", "input_hash"], "left_semi")
    found = fresh.groupBy("memory_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("_found"))
    return records.join(found, "memory_id", "left").withColumn("tags", F.array_union("tags", F.coalesce("_found", F.array().cast("array<string>")))).drop("_found")


def publication_target(head: str | None, source: str, rebased: bool) -> str:
    """Where a result goes: to the head it was made for, to a new head whose meaning is the same, or nowhere."""
    if head == source:
        return "publish"
    return "rebase" if head is not None and rebased else "discard"
