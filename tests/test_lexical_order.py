"""Texts that are alike get one score to the last bit, wherever their postings lie, so that ids decide their order."""

from pyspark.sql import functions as F

from stratalens.operators.lexical import LexicalIndex, bm25_indexed, bm25_top_k


def test_alike_texts_stand_in_the_order_of_their_ids(spark):
    words = [f"w{i}" for i in range(6)]
    rows = [("en", doc, words[(doc + i) % 6], 1 + (doc + i) % 6 % 4, 20, 0, 0) for doc in range(60) for i in range(6)]
    rows += [("en", 100 + 7 * i + n, w, 1, 9, 0, 0) for i, w in enumerate(words) for n in range(i + 1)]  # the words differ in frequency
    postings = spark.createDataFrame(rows, "space_id string, memory_id long, term string, tf long, length long, segment int, bucket int")
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(64)).cast("int")).coalesce(1)
    spaces = spark.createDataFrame([("en", 2_000, 37_003, 0)], "space_id string, documents long, tokens long, segment int")
    index = LexicalIndex(postings, spaces)
    scores = {r.score for r in bm25_indexed(index, " ".join(words)).where("memory_id < 60").collect()}
    assert len(scores) == 1
    assert [r.memory_id for r in bm25_top_k(index, " ".join(words), ["en"], 60).collect()] == list(range(60))


def test_a_query_without_terms_finds_nothing(spark):
    postings = spark.createDataFrame([("en", 1, "w", 1, 9, 0, 0)], "space_id string, memory_id long, term string, tf long, length long, segment int, bucket int")
    spaces = spark.createDataFrame([("en", 1, 9, 0)], "space_id string, documents long, tokens long, segment int")
    assert bm25_indexed(LexicalIndex(postings, spaces), " .. ").count() == 0
