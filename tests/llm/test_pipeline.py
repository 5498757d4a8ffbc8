import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratalens.llm.line_dedup import line_keys
from stratalens.llm.packing import cut


def fixture(tmp_path, spark):
    r = random.Random(11)
    vocab = {"xx": [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "pi", "du")], "yy": [f"{a}{b}" for a in ("sch", "ung", "öb", "eich") for b in ("ter", "heit", "ß", "ein")]}
    rows, labels = [], []
    for i in range(700):
        lang = r.choice(["xx", "yy"])
        words = [r.choice(vocab[lang]) for _ in range(r.randrange(8, 120))]
        toxic = r.random() < 0.12
        if toxic:
            words[r.randrange(len(words))] = r.choice(["blarg", "vexor"])
        text = " ".join(words) + ("\nAll rights reserved, as ever." if r.random() < 0.3 else "")
        rows.append((i, text, lang, f"src{i % 5}", len(text)))
        labels.append((i, 1, int(toxic)))
    extra = [(1000 + i, rows[i][1], *rows[i][2:]) for i in range(0, 100, 7)]
    extra += [(2000, None, "xx", "s", 0), (2001, "", "yy", "s", 0), (2002, "4711 %", None, None, None), (2003, "漢字 " * 50, None, "s", 1)]
    spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows + extra


def test_against_a_plain_version(spark, tmp_path):
    rows = fixture(tmp_path, spark)
    docs = [(i, t) for i, t, *_ in rows]
    # plain versions of what the stages decide
    docs = [(i, t) for i, t in docs if not any(w in (t or "").lower().split() for w in ("blarg", "vexor"))]
    docs = [(i, t) for i, t in docs if i not in (2000, 2001, 2002, 2003)]
    seen = {}
    for i, t in docs:
        for k in set(line_keys(t)):
            seen.setdefault(k, set()).add(i)
    docs = [(i, "\n".join(line for line, k in zip(t.split("\n"), line_keys(t)) if not k or len(seen[k]) < 10)) for i, t in docs]
    def shingles(t):
        parts = t.lower().split()
        return {tuple(parts[n : n + min(5, len(parts))]) for n in range(max(1, len(parts) - 4))} if parts else set()

    sets, comp = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}
    ids = sorted(comp)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if comp[i] != comp[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    kept = [(i, t) for i, t in docs if comp[i] == i]
    assert len(kept) < len(docs)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in kept:
        own = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, n, at, own[at : at + length]) for n, (at, length) in enumerate(cut(len(own), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((g.doc_id, g.piece, g.start, list(g.ids)) for g in got.collect()) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
