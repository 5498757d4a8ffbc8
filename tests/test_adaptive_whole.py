from pyspark.sql import functions as F

from stratalens import queries


def test_tiebreak_places_every_row(spark, monkeypatch):
    n = 12_000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "S0").otherwise("S1").alias("space_id"), F.col("id").alias("memory_id"), F.lit("k1").alias("tag"), F.when(F.col("id") % 5 == 0, "rejected").otherwise("used").alias("outcome"), (F.lit(1_709_000_000_000_000) + F.col("id") * 1_000_000).alias("micros"))
    monkeypatch.setattr(queries.T, "feedback", lambda spark, sf_dir: events)
    got = queries.QUERIES["adaptive_tiebreak"](spark, "").collect()
    assert sorted(r.place for r in got) == list(range(1, n + 1))
    by = sorted(got, key=lambda r: r.place)
    keys = [(-r.relevance, -r.prior) for r in by]
    assert keys == sorted(keys)
