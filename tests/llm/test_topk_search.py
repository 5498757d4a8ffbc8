import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import topk_search
from stratalens.llm.topk_search import exact_top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, scale, is_query):
    sound = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in sound if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("per_block", [4096, 3])
def test_matches_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", per_block)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0, 2.0]), (2010, [3.0, 4.0]), (None, [1.0] * 8), (2050, [-1e6] * 8)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k in (1, 5, 200):
        got = sorted(map(tuple, exact_top_k(frame, F.col("vec_id") % 205 == 0, k=k).collect()))
        assert got == brute(rows, k, 256, lambda i: i % 205 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [3e6 + i * 1024, -2e6, 1e6]) for i in range(20)]
    got = sorted(map(tuple, exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=3).collect()))
    assert got == brute(rows, 3, 256, lambda i: i == 0)


def test_empty_and_no_query(spark):
    assert exact_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_top_k(spark.createDataFrame([(1, [1.0])], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_top_k(spark.createDataFrame([(50, [1.0])], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, [1.0], 0.5), (1, [1.0], 0.5), (2, [2.0], 0.5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = sorted(map(tuple, exact_top_k(frame, F.col("vec_id") == 2, k=5).collect()))
    assert got == [(2, 1, 1, 131072), (2, 2, 1, 131072)]
