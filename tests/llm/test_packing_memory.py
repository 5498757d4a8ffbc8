"""With ids, a worker hands its rows on in short batches, and its encoder keeps fewer pieces."""

import public_tokenizers
import pyarrow as pa

from stratalens.llm import packing, tokens


def test_rows_with_ids_leave_in_short_batches(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    asked = []
    monkeypatch.setattr(packing, "TaskContext", Context)
    monkeypatch.setattr(packing, "encoder", lambda *a: asked.append(a) or tokens.encoder(*a))
    texts = [f"a text of number {i}" for i in range(3_000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(packing._pieces(path, 2048, 0, True)(iter([batch])))
    assert [d for b in out for d in b.column(1).to_pylist()] == list(range(3_000))
    assert max(b.num_rows for b in out) <= packing.ROWS_WITH_IDS + 1
    assert asked == [(path, packing.KNOWN_WITH_IDS)]


def test_pieces_with_ids_are_placed_where_they_lie(docs):
    rows = [(i, "word " * (i % 90)) for i in range(300)]
    got = packing.pack_documents(docs(rows, parts=5), public_tokenizers.path("byte_bpe_50k.json"), max_len=64, with_ids=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and not any(x in plan for x in ("Exchange", "Join", "MapInArrow"))  # ids are neither shuffled nor sent to Python
    assert got.agg({"length": "sum"}).first()[0] == sum(i % 90 + 1 + (i % 90 > 0) for i, _ in rows)
