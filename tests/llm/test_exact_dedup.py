import hashlib
import random

import pytest

from stratalens.llm.exact_dedup import CHUNK, OP2_SQL, _Outbox, exact_dedup, merged_runs, tree_shape


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = max if largest else min
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        out += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_matches_brute_force(docs, keep):
    r = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else r.choice(["", "a", "A", "é" * 500, f"t{r.randrange(200)}"])) for i in range(3000)] + [(5000, None)]
    got = sorted(map(tuple, exact_dedup(docs(rows, parts=7), keep=keep).collect()), key=str)
    assert got == brute(rows, keep == "largest")


def test_repeated_rows_keep_one_and_null_ids_lose(docs):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y"), (2, "z" * 300_000)]
    got = exact_dedup(docs(rows)).collect()
    assert len(got) == 6
    of_x = [g for g in got if g.group_size == 3]
    assert all(g.keep_id == 1 for g in of_x) and sum(g.kept for g in of_x) == 1
    of_y = [g for g in got if g.group_size == 2]
    assert all(g.keep_id is None for g in of_y) and sum(g.kept for g in of_y) == 1


def test_empty_table_and_clashing_columns(docs, spark):
    assert exact_dedup(docs([])).count() == 0
    frame = spark.createDataFrame([(1, "a", 9, "n")], "doc_id long, text string, kept int, digest string")
    assert exact_dedup(frame).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup(frame).first().kept is True


def test_tree_is_binomial():
    assert [tree_shape(w) for w in (1, 2, 5, 8, 200, 1024)] == [(2, 1), (2, 1), (4, 2), (8, 3), (128, 7), (1024, 10)]


def test_many_runs_merge_without_a_sort():
    r = random.Random(3)
    entries, chunks = {}, []
    for run in range(9):
        box = _Outbox(1)
        for n in sorted(r.sample(range(9000), r.choice([1, 50, 3 * CHUNK]))):
            key, best = hashlib.sha256(b"%d" % (n % 5)).digest()[:4] + n.to_bytes(44, "big"), r.choice([None, r.randrange(99)])
            entries.setdefault(key, []).append((best, run))
        for key in sorted(k for k, own in entries.items() if own[-1][1] == run):
            box.add(0, 0, (key, *entries[key][-1], 1))
        box.close()
        chunks += [(first, packed) for _, first, packed in box.ready]
    got = list(merged_runs(iter(sorted(chunks)), largest=False))
    assert [g[0] for g in got] == sorted(entries)
    for key, best, _, n in got:
        known = [b for b, _ in entries[key] if b is not None]
        assert n == len(entries[key]) and best == (min(known) if known else None)


def test_the_sql_agrees(spark, tmp_path):
    import duckdb

    from stratalens.llm.exact_dedup import op2_exact_dedup

    rows = [(i, None if i % 50 == 0 else f"t{i % 37}" if i % 3 else "hot") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(x) for x in op2_exact_dedup(spark, str(tmp_path)).collect()) == sorted(con.execute(OP2_SQL).fetchall())
