import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratalens.llm.sharding import place_large, shard_documents


def shares(got, rows, shards=16):
    load = Counter()
    for g in got:
        load[g.shard] += g.size
    return [load[s] for s in range(shards)]


def check(got, rows):
    assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for g in got:
        assert g.law == "bytes" and g.grown_shard is None and 0 <= g.shard < 16
        slots[g.shard].append(g.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_bytes_tokens_and_rows_are_near_equal(docs):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(1, 9) + " word" * int(r.lognormvariate(4, 1))) for i in range(6000)]
    got = shard_documents(docs(rows, parts=8)).collect()
    check(got, rows)
    load = shares(got, rows)
    assert max(load) < 1.01 * sum(load) / 16
    for measure in (lambda g: 1, lambda g: g.tokens):
        c = Counter()
        for g in got:
            c[g.shard] += measure(g)
        assert max(c.values()) < 1.03 * sum(c.values()) / 16


def test_a_group_of_a_third_is_split_and_others_stay_together(docs):
    r = random.Random(2)
    rows = [(i, "hot text here") for i in range(3000)] + [(10_000 + i, f"t{i % 900} " + "y" * (i % 900 % 7)) for i in range(6000)]
    got = shard_documents(docs(rows, parts=8)).collect()
    check(got, rows)
    load = shares(got, rows)
    assert max(load) < 1.05 * sum(load) / 16 and min(load) > 0.95 * sum(load) / 16
    of = defaultdict(set)
    text = dict(rows)
    for g in got:
        of[text[g.doc_id]].add(g.shard)
    assert len(of["hot text here"]) > 4 and all(len(s) == 1 for t, s in of.items() if t != "hot text here")


def test_a_group_that_fits_in_a_shard_is_not_split(docs):
    """Groups between an eighth and nearly the whole of a shard."""
    r = random.Random(5)
    many = {"a third": 180, "the half": 280, "the most": 500}
    rows = [(i, t) for t, n in many.items() for i in range(n)]
    rows += [(i, f"t{i} " + "y" * r.randrange(9)) for i in range(9600 - len(rows))]
    got = shard_documents(docs([(n, t) for n, (_, t) in enumerate(rows)], parts=8)).collect()
    of = defaultdict(set)
    for g in got:
        of[rows[g.doc_id][1]].add(g.shard)
    assert all(len(s) == 1 for s in of.values())
    load = shares(got, rows)
    assert max(load) < 1.02 * sum(load) / 16 and min(load) > 0.93 * sum(load) / 16  # the shards of large groups are full by rows first


def test_only_what_has_no_room_is_split():
    residual = np.ones((4, 3))
    got = place_large(np.array([[1.2] * 3, [0.7] * 3, [0.6] * 3, [0.5] * 3, [0.4] * 3, [0.4] * 3]), residual)
    assert got[0] == [(at, 0.25) for at in range(4)]
    assert [len(own) for own in got[1:]] == [1, 1, 1, 1, 2]
    assert all(sum(p for _, p in own) == pytest.approx(1) for own in got) and (residual > -0.01).all()
    for own in place_large(np.array([[5.0] * 3]), np.ones((4, 3))):  # more than there is
        assert sum(p for _, p in own) == pytest.approx(1) and {s for s, _ in own} == {0, 1, 2, 3}


def test_nulls_repeats_long_and_empty(docs, spark):
    rows = [(1, None), (1, None), (None, "a"), (2, ""), (3, "z " * 100_000)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, shard int")
    check(shard_documents(frame).collect(), rows)
    assert shard_documents(docs([])).count() == 0
