import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalens.llm.packing import SumIndex, cut, lay_out, pack_documents, plan_packing
from stratalens.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def bins(plan):
    return sum(times for _, times in plan)


def valid(plan, counts, cap):
    used = Counter()
    for what, times in plan:
        assert sum(n * c for n, c in what) <= cap
        for n, c in what:
            used[n] += c * times
    assert used == Counter({n: c for n, c in counts.items() if c})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 50), max_size=12))
def test_plans_hold_every_piece_once(counts):
    plan = plan_packing(counts, 40)
    valid(plan, counts, 40)
    lay_out(plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=25, max_size=25), st.lists(st.tuples(st.integers(1, 23), st.integers(1, 3)), max_size=40))
def test_the_index_finds_a_combination_if_there_is_one(counts, asked):
    """Against all combinations, while the stock falls."""
    stock = np.array([0, *counts[1:]])
    index = SumIndex(stock)
    for length, size in asked:
        if not stock[length]:
            continue
        gap = 24 - length
        every = [c for c in itertools.combinations_with_replacement(range(1, gap + 1), size) if sum(c) == gap and all(stock[n] >= m for n, m in Counter((length, *c)).items())]
        found = index.fillers(length, gap, size)
        assert (found is not None) == bool(every)
        if found:
            assert tuple(sorted((found - Counter((length,))).elements())) in every
            for n, m in found.items():
                stock[n] -= m


def test_a_table_with_columns_named_as_those_within(spark):
    names = ["piece", "start", "length", "rank", "part", "nth", "sequence_id", "offset"]
    got = pack_documents(spark.createDataFrame([(1, "a b", *range(8))], ["doc_id", "text", *names]), BYTES)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 1


def test_exact_combinations_fill_sequences():
    assert bins(plan_packing({30: 5, 10: 5}, 40)) == 5
    assert bins(plan_packing({20: 3, 12: 3, 8: 3}, 40)) == 3
    assert bins(plan_packing({25: 2, 8: 2, 4: 2, 3: 2}, 40)) == 2
    assert bins(plan_packing({40: 7}, 40)) == 7 and plan_packing({}, 40) == []
    assert bins(plan_packing({10: 9}, 40)) == 3


def test_near_the_lower_bound():
    r = random.Random(5)
    counts = Counter(min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(30_000))
    plan = plan_packing(counts, 2048)
    valid(plan, counts, 2048)
    assert bins(plan) <= math.ceil(sum(n * c for n, c in counts.items()) / 2048) * 1.002


def test_cuts():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def test_pieces_lie_as_said(docs):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma,", "\n", "ü"]) for _ in range(r.randrange(0, 90)))) for i in range(400)] + [(900, None), (901, "x " * 9000), (None, "null id"), (5, "same"), (5, "same")]
    tok = Tokenizer.from_file(BYTES)
    got = pack_documents(docs(rows, parts=5), BYTES, max_len=64, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for g in got:
        assert g.length == len(g.ids) and g.ids_crc32 == zlib.crc32(np.array(g.ids, np.uint32).tobytes())
        by_doc[g.doc_id].append(g)
        by_sequence[g.sequence_id].append((g.offset, g.length))
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda g: g.piece)
        if i != 5:
            assert [x for g in own for x in g.ids] == ids and [(g.start, g.length) for g in own] == cut(len(ids), 64)
    assert len(by_doc[5]) == 3  # ids 5 of the loop, and the repeated row
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table(docs):
    assert pack_documents(docs([]), BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_as_whole_texts(path):
    r, tok, own = random.Random(8), Tokenizer.from_file(path), Encoder(path, most=50)
    alphabet = ["a", "Ab", "é", "é", "Σ", "ΑΣ", "İ", "1", "½", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "​", "<|endoftext|>", "<|", "|>", "😀", "́", "中", "힣", "가", "ﬁ", "Å", "\u0085", "﻿"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 14)))
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
