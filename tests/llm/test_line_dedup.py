import random

import numpy as np
import pytest

from stratalens.llm.bloom import BITS_A_LINE, MOST_BITS, Filter, filter_bits_for
from stratalens.llm.line_dedup import OP4_SQL, drop_repeated_lines, line_keys


def brute(rows, min_docs, min_chars, keep):
    seen = {}
    for n, (i, t) in enumerate(rows):
        for k in set(line_keys(t)):
            if len(k.decode()) >= min_chars:
                seen.setdefault(k, []).append((i is None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(rows):
        lines, left, had = (t or "").split("\n"), [], set()
        for line, k in zip(lines, line_keys(t)):
            common = len(seen.get(k, ())) >= min_docs
            first = keep == "first" and common and min(seen[k])[2] == n and k not in had
            had.add(k)
            if not common or first:
                left.append(line)
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bits, sent", [(12, 0), (12, 1000), (20, 0), (None, 1000)])
def test_matches_brute_force(docs, keep, bits, sent):
    """With 2^12 bits nearly every line is suspected; with no keys sent the lines are joined to their rows: the result is the same."""
    r = random.Random(4)
    pool = ["", " ", "Licence text", " licence TEXT\r", "É", "é", "\x1fodd", *(f"line {i}" for i in range(60))]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else f"own {i} {j}" for j in range(r.randrange(1, 12)))) for i in range(300)]
    rows[7] = (7, None)
    frame = docs(rows, parts=6)
    for least in (1, 8):
        got = sorted(map(tuple, drop_repeated_lines(frame, min_docs=10, min_chars=least, keep=keep, filter_bits=bits, sent_keys=sent).collect()), key=str)
        assert got == brute(rows, 10, least, keep)


def test_nulls_long_texts_repeats_and_columns(spark, docs):
    many = "\n".join(f"m{i}" for i in range(30_000))
    rows = [(1, None, "a", 1), (None, "x\ny", "b", 2), (None, "x\ny", "b", 2), (3, many, "c", 3), (4, many + "\nz", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, line_parts int")
    got = drop_repeated_lines(frame, min_docs=2)
    assert got.columns == ["doc_id", "text", "line_parts", "n_lines", "n_dropped"]
    by = sorted(((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()), key=str)
    assert by == sorted([(1, "", 1, 0), (None, "", 2, 2), (None, "", 2, 2), (3, "", 30_000, 30_000), (4, "z", 30_001, 30_000)], key=str)
    assert drop_repeated_lines(docs([])).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_columns_named_as_those_within(spark, sent):
    names = ["__row_a", "__row_b", "__gone", "gone_row_a", "gone_row_b", "lines_gone", "line_row_a", "line_text", "digest", "first"]
    rows = [(i, f"own {i}\nshared", *range(len(names))) for i in range(12)]
    got = drop_repeated_lines(spark.createDataFrame(rows, ["doc_id", "text", *names]), sent_keys=sent).collect()
    assert sorted(tuple(x) for x in got) == [(i, f"own {i}", *range(len(names)), 2, 1) for i in range(12)]


def test_the_sql_agrees(spark, tmp_path):
    import duckdb

    from stratalens.llm.line_dedup import op4_line_dedup

    r = random.Random(9)
    pool = ["", " Licence text", "licence TEXT\r", *(f"line {i}" for i in range(30))]
    rows = [(i, None if i == 5 else "\n".join(r.choice(pool) if r.random() < 0.6 else f"own {i} {j}" for j in range(r.randrange(1, 9)))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in op4_line_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(OP4_SQL).fetchall())


@pytest.mark.parametrize("bits", [14, 18, 28])
def test_filter_has_no_false_negatives_and_few_false_positives(bits):
    f, r = Filter(bits), np.random.default_rng(1)
    values = r.integers(0, 2**64, (1 << bits) // BITS_A_LINE if bits < 20 else 20_000, dtype=np.uint64)
    f.add(f.places(values))
    assert f.has(f.places(values)).all()
    assert f.has(f.places(r.integers(0, 2**64, 20_000, dtype=np.uint64))).mean() < 0.02


def test_filters_are_sized_from_the_lines():
    assert filter_bits_for(0) == filter_bits_for(1000) == 20
    assert filter_bits_for(4_000_000) == 26 and filter_bits_for(4_300_000) == 27
    assert filter_bits_for(10**13) == MOST_BITS
