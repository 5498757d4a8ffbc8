"""near_dedup: pairs by SimHash come first, an exact check follows, and the prefix join adds what is farther apart."""

from stratalens.llm import simhash_dedup
from stratalens.llm.jaccard_dedup import similar_components

from .test_jaccard_dedup import brute, corpus


def test_the_simhash_operator_gives_the_first_pairs(docs, monkeypatch):
    rows, seen = corpus(5, 60), []
    original_near, original_drop = simhash_dedup.near_duplicates, simhash_dedup.drop_similar_texts
    monkeypatch.setattr(simhash_dedup, "near_duplicates", lambda df, *more: seen.append(more) or original_near(df, *more))

    def drop(df, id_col, text_col, words, near):
        seen.append(near.columns)
        return original_drop(df, id_col, text_col, words, near)

    monkeypatch.setattr(simhash_dedup, "drop_similar_texts", drop)
    got = simhash_dedup.drop_near_duplicates(docs(rows), words=5)
    assert sorted(r.doc_id for r in got.collect()) == [doc for doc, low in brute(rows) if doc == low]
    assert seen == [("doc_id", "text", 5, simhash_dedup.EXACT_BITS), ["doc_id", "component_id"]]


def test_classes_that_are_given_change_no_result(spark, docs):
    rows = corpus(7, 60)
    want = brute(rows)
    wrong = [(doc, doc // 200 * 200) for doc, _ in rows]  # unrelated texts in one class
    for near in (wrong, want, want[:20]):
        given = spark.createDataFrame(near, "doc_id long, component_id long")
        assert sorted(map(tuple, similar_components(docs(rows), small=4, near=given).collect())) == want
    nothing = spark.createDataFrame([], "doc_id long, component_id long")
    assert similar_components(docs([]), near=nothing).count() == 0
