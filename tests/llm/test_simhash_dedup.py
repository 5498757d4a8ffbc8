import random

import numpy as np
import pytest

from stratalens.llm.components import connected_components
from stratalens.llm.simhash_dedup import drop_near_duplicates, fingerprint, near_duplicates, segment_counts, thermometer


def brute(rows, words, bits):
    fps = [fingerprint(t, words) for _, t in rows]
    arr = np.array(fps, np.uint64)
    left, label = set(range(len(rows))), {}
    while left:
        stack = [left.pop()]
        own = list(stack)
        while stack:
            near = [j for j in np.flatnonzero(np.bitwise_count(arr ^ arr[stack.pop()]) <= bits).tolist() if j in left]
            left -= set(near)
            own += near
            stack += near
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        label |= {i: min(ids) if ids else None for i in own}
    return sorted((rows[i][0], f"{fps[i]:016x}", label[i]) for i in range(len(rows)))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 30, 300]))] for _ in range(n)]
    out = []
    for i, words in enumerate(base):
        out.append((10 * i, " ".join(words)))
        for c in range(r.choice([0, 0, 1, 3])):
            own = list(words)
            own[r.randrange(len(own))] = r.choice(vocab)
            out.append((10 * i + c + 1, " ".join(own)))
    return out


@pytest.mark.parametrize("bits", [0, 1, 4, 5])
def test_components_match_brute_force(docs, bits):
    rows = corpus(bits, 120)
    got = sorted(map(tuple, near_duplicates(docs(rows), words=4, max_bits=bits).collect()))
    assert got == brute(rows, 4, bits)


def test_one_large_group_of_near_copies(docs):
    r = random.Random(7)
    words = [f"x{i}" for i in range(2500)]
    rows = []
    for i in range(900):
        own = list(words)
        for _ in range(r.choice([0, 1, 2, 4])):
            own[r.randrange(len(own))] = f"y{r.randrange(50)}"
        rows.append((i, " ".join(own)))
    got = sorted(map(tuple, near_duplicates(docs(rows)).collect()))
    assert got == brute(rows, 4, 4)


@pytest.mark.parametrize("large", [2, 20, 400])
def test_cells_dealt_again_lose_no_link(docs, large):
    """With a small bound nearly every cell is dealt again by the other half's counts."""
    rows = corpus(23, 100)
    r = random.Random(5)
    words = [f"x{i}" for i in range(1500)]
    for i in range(250):
        own = list(words)
        for _ in range(r.choice([0, 1, 2, 4])):
            own[r.randrange(len(own))] = f"y{r.randrange(50)}"
        rows.append((5000 + i, " ".join(own)))
    for bits in (1, 4):
        got = sorted(map(tuple, near_duplicates(docs(rows), max_bits=bits, large_cell=large).collect()))
        assert got == brute(rows, 4, bits)


def test_manhattan_bounds_hamming():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**63, (2, 2000), dtype=np.uint64)
    manhattan = np.abs(segment_counts(a).astype(int) - segment_counts(b).astype(int)).sum(axis=1)
    assert (manhattan <= np.bitwise_count(a ^ b)).all()
    assert (np.bitwise_count(thermometer(a) ^ thermometer(b)) == manhattan).all()


def test_nulls_empty_repeats_and_extra_columns(docs):
    rows = [(5, None, "a"), (3, "", "b"), (4, " \n\t", "c"), (None, "one two three four five", "d"), (7, "one two three four five", None), (7, "one two three four five", None), (8, "z" * 200_000, "e")]
    frame = docs(rows, "doc_id long, text string, fp string")
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in near_duplicates(frame).collect()), key=str)
    assert len(got) == 7
    by = {x[0]: x for x in got}
    assert by[5][2] == by[3][2] == by[4][2] == 3 and by[3][1] == "0" * 16
    assert by[None][2] == by[7][2] == 7
    kept = drop_near_duplicates(frame, max_bits=4)
    assert sorted(str(x.doc_id) for x in drop_near_duplicates(frame).collect()) == sorted(str(x.doc_id) for x in kept.collect())
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["3", "7", "7", "8", "None"]


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0


def test_long_chain_of_links(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n + 2), (n + 5, n + 5)], "a long, b long")
    got = connected_components(edges).collect()
    assert len(got) == n + 2 and len({x.root for x in got if x.node < n}) == 1


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled", "star"])
def test_rounds_and_jumps_grow_with_the_logarithm(spark, order):
    n = 3000
    ids = list(range(n))
    if order == "descending":
        ids.reverse()
    elif order == "shuffled":
        random.Random(2).shuffle(ids)
    pairs = [(n, i) for i in ids] if order == "star" else [(ids[i], ids[i + 1]) for i in range(n - 1)]
    rounds: list[int] = []
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), rounds).collect()
    assert len({x.root for x in got}) == 1 and len(got) == n + (order == "star")
    assert len(rounds) <= 12 and max(rounds) <= 13
