"""The registered queries themselves, on the smallest tables: the columns of their contracts, one row for each document, and the SQL where there is some."""

import os
import zlib

import duckdb
import pytest

from stratalens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_topk_search": "query_id rank vec_id score",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op5_simhash_dedup": "doc_id fingerprint component_id",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_token_files": "doc_id start n_tokens ids_crc32",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = COLUMNS[name].split()
    assert set(wanted) <= set(found.columns)
    rows = found.collect()
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    if name in ORACLE_SQL:
        assert sorted(tuple(r[c] for c in wanted) for r in rows) == sorted(duck.sql(f"SELECT {', '.join(wanted)} FROM ({ORACLE_SQL[name]})").fetchall())
    elif name == "op3_best_fit_packing":
        assert {r.doc_id for r in rows} == set(texts) and max(r.length for r in rows) <= 2048
    else:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op10_sharding":
        assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    if "held_out" in wanted:
        folds, rest = (4, 2) if name.startswith("op6") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) for r in rows)
