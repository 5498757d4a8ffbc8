import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from stratalens.llm import token_files
from stratalens.llm.token_files import TokenFile, open_file, read_token_files, to_bytes, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_and_single_tokens():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1500, 255), (5000, 300), (20_000, 49_408), (3000, 2**32 - 1)):
        ids = r.integers(0, top, n, dtype=np.uint32)
        f = TokenFile(pa.BufferReader(to_bytes(ids, [7] if n else [], [n] if n else [])))
        assert (f.slice(0, n) == ids).all() and f.tokens == n
        for i in r.integers(0, n, 60).tolist() if n else []:
            assert f.token(i) == ids[i]
            j = min(n, i + 900)
            assert (f.slice(i, j) == ids[i:j]).all()


def test_files_hold_all_documents_in_order(docs, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Über", "the", "dog's", "42", "\n", "naïve."]) for _ in range(r.randrange(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, "word " * 40_000), (1002, "same"), (1002, "same")]
    files = write_token_files(docs(rows, parts=4), f"file://{tmp_path}/out", WORDS)
    got = sorted(map(tuple, read_token_files(files, with_ids=True).collect()))
    tok, at, want = Tokenizer.from_file(WORDS), 0, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert got == sorted(want)
    first = files.orderBy("start").first()
    assert open_file(first.path).token(0) == want[0][4][0]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_nulls_and_empty(docs, tmp_path):
    files = write_token_files(docs([(None, "b"), (None, None), (-3, "x")], parts=2), f"file://{tmp_path}/a", WORDS)
    got = read_token_files(files).collect()
    assert sorted(g.start for g in got)[0] == 0 and [g.doc_id for g in sorted(got, key=lambda g: g.start)] == [None, None, -3]
    none = write_token_files(docs([]), f"file://{tmp_path}/b", WORDS)
    assert none.count() == 0 and read_token_files(none).count() == 0


def test_tasks_roll_over_to_further_files(docs, tmp_path):
    rows = [(i, "a b c d") for i in range(500)] + [(1000, "word " * 900)]
    files = write_token_files(docs(rows), f"file://{tmp_path}/c", WORDS, file_tokens=60).orderBy("start").collect()
    assert len(files) > 40 and all(f.tokens <= 64 for f in files[:-1]) and files[-1].tokens >= 901
    assert [f.start for f in files] == [sum(g.tokens for g in files[:n]) for n in range(len(files))]
    assert sum(f.tokens for f in files) == 5 * 500 + 901
    again = write_token_files(docs(rows), f"file://{tmp_path}/d", WORDS)
    small = write_token_files(docs(rows), f"file://{tmp_path}/e", WORDS, file_tokens=60)
    assert sorted(map(tuple, read_token_files(again).collect())) == sorted(map(tuple, read_token_files(small).collect()))
    assert token_files.FILE_TOKENS <= 4_000_000


def test_columns_named_as_those_within(spark, tmp_path):
    names = ["id", "tie", "start", "tokens", "part", "path", "n_tokens"]
    frame = spark.createDataFrame([(1, "a b", *range(7))], ["doc_id", "text", *names])
    got = read_token_files(write_token_files(frame, f"file://{tmp_path}/f", WORDS))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.first()[:3] == (1, 0, 3)


def test_the_list_of_files_is_few_parquet_files(docs, tmp_path):
    files = write_token_files(docs([(i, "a b c d") for i in range(500)]), f"file://{tmp_path}/g", WORDS)
    assert files.count() > 4 and len(files.inputFiles()) == 1  # not one for each task
