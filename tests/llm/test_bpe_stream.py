import hashlib
import json
import random
import resource

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalens.llm import bpe_stream
from stratalens.llm.bpe_stream import Codec, MergeList, Transducer, _byte_of_character, encode_and_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return Codec(PATH, most=500)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_every_token_is_its_own_encoding_or_unreachable(own, tok):
    r = random.Random(0)
    for raw in r.sample(sorted(own.merges.reachable), 3000):
        t = Transducer(own.merges)
        ids = [*t.feed(raw), *t.end()]
        assert b"".join(own.merges.bytes_of[i] for i in ids) == raw


def test_random_texts(own, tok):
    r = random.Random(1)
    alphabet = ["a", "b", "aa", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "'s", "'", "1", "99", "½", "<|endoftext|>", "<|", " the", "ing", "tion", "-", "--", "===", " ", "\x1c", "\x85", "​", "́", "A", "ZZ", "\0"]
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 30)))
        ids = own.encode(text).tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_one_letter_runs_and_dense_merges(own, tok):
    r = random.Random(2)
    for letters in ("a", "ab", "aeinrst", "=", "-", "=-", "abcdefghijklmnopqrstuvwxyz", "é", "中"):
        for n in (1, 2, 3, 5, 8, 40, 129, 700):
            text = "".join(r.choice(letters) for _ in range(n))
            assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, (letters, n)


def test_long_pretokens_stream_in_bounded_memory(own, tok):
    r = random.Random(3)
    for letters in ("a", "etaoinsr", "lkjn"):
        text = "".join(r.choice(letters) for _ in range(60_000))
        t = Transducer(own.merges)
        early = [i for at in range(0, len(text), 777) for i in t.feed(text[at : at + 777].encode())]
        assert early, "nothing came out before the end"
        assert t.most_held < 6 * own.merges.lookahead + 4096
        assert early + list(t.end()) == tok.encode(text, add_special_tokens=False).ids


def test_any_chunks_give_the_same_ids(own, tok, monkeypatch):
    """Chunks of any size, long runs of every kind, and so small a bound that most pre-tokens are fed as they come."""
    r = random.Random(6)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "'s", "'", "'l", "'re", "1", "99", "½", "<|endoftext|>", "<|", "<", " the", "=", "-", "...", "\x1c", "\x85", "A" * 30, " " * 30, "\n" * 20, "7" * 25, "'" * 9]
    for waiting in (3, 8, 1 << 12):
        monkeypatch.setattr(bpe_stream, "WAITING", waiting)
        for _ in range(1500):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 25)))
            chunks, at = [], 0
            while at < len(text):
                step = r.choice([1, 2, 3, 7, 40])
                chunks.append(text[at : at + step])
                at += step
            got = np.frombuffer(b"".join(own.stream(chunks)), np.uint32).tolist()
            assert got == tok.encode(text, add_special_tokens=False).ids, (waiting, chunks)


def test_a_text_of_100_mb_needs_constant_memory(own, tok):
    r = random.Random(7)
    words = [f" {r.choice(['the', 'Über', 'x1', 'dog', 'naïve'])}{r.choice([',', '', '.', ' (and)'])}" for _ in range(12_000)]
    plain = "".join(words)

    def chunks():
        for n in range(100_000_000 // 65_536):
            if n % 500 == 250:
                yield "z" * 100_000  # one pre-token
                yield " \n" * 20_000
            yield plain[:65_536]

    list(own.stream([plain[:65_536], " zz" + "z" * 50_000, " \n" * 5000]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    tokens = sum(len(ids) // 4 for ids in own.stream(chunks()))
    assert tokens > 20_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000  # KB


def test_decoding_arbitrary_ids_replaces_broken_bytes(own, tok):
    r = random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50_257) if r.random() < 0.5 else r.randrange(256) for _ in range(r.randrange(1, 40))]
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
        assert "".join(own.decoded(ids, chunk=3)) == own.decode(ids)


def test_small_merge_list_against_naive_merging(tmp_path):
    of = {b: c for c, b in _byte_of_character().items()}
    merges = [["a", "b"], ["b", "c"], ["c", "a"], ["ab", "ca"], ["a", "a"], ["aa", "b"], ["bc", "ab"]]
    vocab = {of[b]: b for b in range(256)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges}}))
    ml, r = MergeList(str(path)), random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 25)))
        parts = list(text)
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        t = Transducer(ml)
        assert [*t.feed(text.encode()), *t.end()] == [vocab[p] for p in parts], text


def test_frame_nulls_columns_and_empty(spark, docs, tok):
    rows = [(1, None, "x"), (2, "", None), (3, "wörd " * 40_000, "y"), (3, "a<|endoftext|>b", "y"), (None, "q", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_and_decode(frame, PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    by = {x.text: x for x in got.collect()}
    for _, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert by[t].ids == ids and by[t].decoded == (t or "")
    assert encode_and_decode(docs([]), PATH).count() == 0
    assert hashlib.sha256(by["q"].decoded.encode()).hexdigest()
