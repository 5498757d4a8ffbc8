import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm.language_id import LanguageModel, cluster, fit_language_model, fold, grams, has_letter, identify_language, sample_bound
from stratalens.llm.toxicity import AIMED, CLASSES, INSULT, INSULTS, NEGATION, OBJECT, REACH, REPORT, SUBJECT, THREAT, Grammar, candidates, composed, fit_grammar, lexicon, machine, score_toxicity

SYLLABLES = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ei", "ung", "öb"], "zz": ["eau", "é", "ois", "qu"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(seed, n):
    r = random.Random(seed)
    return [(i, prose(r, lang := r.choice("xx yy zz".split()), r.randrange(3, 60)), lang) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus(1, 900)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    held = fold("doc_id", 4) == 2
    model = fit_language_model(frame, ~held, per_language=100)
    got = identify_language(frame.where(held), model).collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows)
    assert sum(g.lang == g.lang_pred for g in got) > 0.98 * len(got)
    assert all(0 <= g.score <= 1 for g in got) and sum(g.rejected for g in got) < 0.02 * len(got)


def test_the_sample_is_bounded_and_labels_stay_out(spark):
    frame = spark.createDataFrame(corpus(2, 2000), "doc_id long, text string, lang string")
    model = fit_language_model(frame, F.lit(True), per_language=20)
    assert model.names == ["xx", "yy", "zz"] and 3 <= len(model.centres) <= 12
    a = identify_language(frame.select("doc_id", "text", F.lit("xx").alias("lang")), model).orderBy("doc_id").select("lang_pred").collect()
    b = identify_language(frame.select("text", "doc_id", F.lit(None).cast("string").alias("lang")), model).orderBy("doc_id").select("lang_pred").collect()
    assert a == b


def test_predictions_match_brute_force_given_a_model(spark):
    """Every text against every centroid, its n-grams counted one by one in a dictionary."""
    frame = spark.createDataFrame(corpus(6, 200), "doc_id long, text string, lang string")
    model = fit_language_model(frame, F.lit(True), per_language=40)

    def brute(text):
        if not has_letter(text):
            return "und"
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
        counts = {}
        for n, lead in ((2, 1 << 24), (3, 0)):
            for i in range(len(raw) - n + 1):
                if raw[i : i + 2] != b"  ":
                    place = ((lead | int.from_bytes(raw[i : i + n], "big")) * 2654435761 & 0xFFFFFFFF) >> 20
                    counts[place] = counts.get(place, 0) + 1
        vector = {p: (1 + math.log(c)) * float(model.idf[p]) for p, c in counts.items()}
        return model.names[model.of[max(range(len(model.of)), key=lambda c: sum(v * float(model.centres[c][p]) for p, v in vector.items()))]]

    rows = [(i, t) for i, t, _ in corpus(7, 60)] + [(100, None), (101, "12"), (102, "A kalo-Mitu öb")]
    got = {g.doc_id: g.lang_pred for g in identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_the_sample_never_vanishes(spark):
    """Bounds on the hash at any number of rows: about twice the sample is drawn, whatever its share."""
    for rows in (10, 10**6, 10**10, 6 * 10**11, 10**15):
        share = (sample_bound(500, rows) + (1 << 63) + 1) / (1 << 64)
        assert share * rows == pytest.approx(min(1000, rows), rel=1e-3)
    frame = spark.createDataFrame(corpus(2, 3000), "doc_id long, text string, lang string")
    model = fit_language_model(frame, F.lit(True), per_language=7)
    assert model.names == ["xx", "yy", "zz"]


def test_language_edge_cases(spark, docs):
    frame = spark.createDataFrame(corpus(3, 300), "doc_id long, text string, lang string")
    model = fit_language_model(frame, F.lit(True))
    odd = [(1, None), (2, ""), (3, "123 %% \n"), (4, "漢字かな交じり文 " * 40), (None, "kalo mitu " * 30_000), (5, "kalo"), (5, "kalo")]
    by = {(g.doc_id, g.text and g.text[:5]): g for g in identify_language(docs(odd), model).collect()}
    for key in ((1, None), (2, ""), (3, "123 %")):
        assert by[key].lang_pred == "und" and by[key].score == 0 and by[key].rejected
    assert by[4, "漢字かな交"].rejected and by[4, "漢字かな交"].lang_pred in model.names
    assert by[None, "kalo "].lang_pred == "xx" and not by[None, "kalo "].rejected
    assert identify_language(docs([]), model).count() == 0
    clash = spark.createDataFrame([(1, "kalo", 7, "q")], "doc_id long, text string, score int, text_to_identify string")
    assert identify_language(clash, model).columns == ["doc_id", "text", "text_to_identify", "lang_pred", "score", "rejected"]
    none = fit_language_model(docs([], "doc_id long, text string, lang string"), F.lit(True))
    assert identify_language(docs([(1, "abc")]), none).first().lang_pred == "und"


def test_centroids_and_whole_texts():
    a, b = grams("kalo " * 400_000), grams("kalo " * 400_000 + "ß")
    assert (a != b).any(), "the end of a very long text counts"
    assert cluster((v := LanguageModel(["xx"], grams("kalo")[None]).centres), 3).shape == v.shape


def test_a_language_keeps_a_centroid_for_each_register():
    """Two registers of a language and a few outliers that resemble neither."""
    r = random.Random(4)

    def text(syllables):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(60))

    registers = [["ka", "lo", "mi", "tu", a, b] for a, b in (("gre", "fop"), ("zin", "dux"))]
    texts = [text(registers[i % 2]) for i in range(200)] + [text(SYLLABLES["yy"]), text(SYLLABLES["zz"]), "q", "w 1", "e"]
    model = LanguageModel(["xx"] * len(texts), np.stack([grams(t) for t in texts]))
    of = np.stack([grams(t) for t in texts[:200]]) * model.idf @ model.centres.T
    sizes = np.bincount(of.argmax(axis=1), minlength=len(model.centres))
    assert len(model.centres) > 1 and sizes.min() >= 0.05 * 200
    assert not set(of.argmax(axis=1)[0::2]) & set(of.argmax(axis=1)[1::2]), "no centroid is of both registers"


def toxic_corpus(seed, n):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(r, r.choice("xx yy".split()), r.randrange(20, 80)).split()
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["blarg", "vexo" + r.choice(SYLLABLES["xx"])]))
        rows.append((i, " ".join(words) + ".\n" + prose(r, "xx", 5)))
        labels.append((i, 1, int(bad)))
    copies = [(n + i, rows[-1][1]) for i in range(60)]
    return rows + copies, labels + [(i, 1, labels[-1][2]) for i, _ in copies]


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus(5, 1500)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = fold("doc_id", 3) == 1
    grammar = fit_grammar(frame, marks, ~held)
    assert set(grammar.entries) - set(INSULTS) <= {"blarg", "blar*", "blarg*", "vexo*"}
    got = score_toxicity(frame, grammar).join(marks, "doc_id").where(held).collect()
    assert all(g.predicted == g.toxic for g in got) and all(0 <= g.score <= 1 for g in got)


def test_matches_are_of_clauses_and_know_their_kind():
    g = Grammar({"blarg": 0.9, "vexo*": 0.8})
    assert list(g.clauses("you are a blarg. nothing here")) == [[("insult+", 0.9)]]
    assert list(g.clauses("Blarg!")) == [[("insult", 0.9)]]
    assert list(g.clauses("not a vexoti")) == [[("insult-", 0.8)]]
    assert list(g.clauses("said vexo; you blarg")) == [[("insult~", 0.8)], [("insult+", 0.9)]]
    assert list(g.clauses("will kill you")) == [[("threat", 1.0)]] and list(g.clauses("kill. you")) == []
    assert list(g.clauses("not one two three four five blarg")) == [[("insult", 0.9)]]
    g.kinds, g.base = {"insult": 1.0, "insult-": 0.5}, 0.01
    assert g.score(None) == g.score("") == g.score("fine text") == pytest.approx(0.01)
    assert g.score("blarg") == pytest.approx(1 - 0.99 * 0.1) and g.score("not blarg") == pytest.approx(1 - 0.99 * 0.55)


@pytest.mark.parametrize("text", ["I will kill you", "ich werde dich töten", "je vais te tuer", "te voy a matar", "voy a matarte"])
def test_threats_find_their_target_on_either_side(text):
    assert list(Grammar().clauses(text)) == [[("threat", 1.0)]]


def test_negation_and_report_on_either_side():
    g = Grammar({"blarg": 0.9})
    assert list(g.clauses("ich töte dich nicht")) == [[("threat-", 1.0)]]
    assert list(g.clauses("a blarg you are")) == [[("insult+", 0.9)]]
    assert list(g.clauses("blarg, he said")) == [[("insult+~", 0.9)]]
    assert list(g.clauses("he kills weeds")) == []


def test_the_composed_machine_matches_brute_force():
    """Against the definition, event by event, on random clauses; and each accepted path once."""
    r, whole, targets = random.Random(3), composed(), (SUBJECT, OBJECT, AIMED)
    for _ in range(3000):
        clause = [r.choice(CLASSES) if r.random() < 0.5 else 0 for _ in range(r.randrange(0, 14))]
        want = []
        for at, c in enumerate(clause):
            others = [(n, x) for n, x in enumerate(clause) if n != at]
            near = lambda of: any(x == of and abs(n - at) <= REACH for n, x in others)  # noqa: B023, E731
            signs = "-" * near(NEGATION) + "~" * near(REPORT)
            if c == INSULT:
                want.append((at, "insult" + "+" * any(x in targets for _, x in others) + signs))
            elif c == AIMED or c == THREAT and (OBJECT in clause[:at] or any(x in targets for x in clause[at:])):
                want.append((at, "threat" + signs))
        assert machine().matches(clause) == want
        paths = [(whole.start, ())]
        for c in clause:
            paths = [(after, (*out, kind)) for state, out in paths for (_, kind), after in whole.step(state, (c, ""))]
        assert sorted(next((n, k) for n, k in enumerate(out) if k) for state, out in paths if whole.final(state)) == want


def test_scores_match_brute_force_given_a_grammar(spark):
    g, r = Grammar({"blarg": 0.9, "vexo*": 0.8}), random.Random(8)
    g.kinds, g.base = {"insult": 0.9, "insult+": 1.0, "insult-": 0.4, "threat": 0.7}, 0.02
    words = ["you", "blarg", "vexoti", "kill", "not", "said", "word", "other", ".", ";", "\n"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(300)]

    def brute(text):
        harmless = 0.98
        for clause in re.split(r"[.;\n]", text):
            own, best = clause.split(), 0.0
            for at, w in enumerate(own):
                near = lambda of: any(x == of and 0 < abs(n - at) <= REACH for n, x in enumerate(own))  # noqa: B023, E731
                signs = "-" * near("not") + "~" * near("said")
                if w in ("blarg", "vexoti"):
                    kind, weight = "insult" + "+" * ("you" in own) + signs, 0.9 if w == "blarg" else 0.8
                elif w == "kill" and "you" in own:
                    kind, weight = "threat" + signs, 1.0
                else:
                    continue
                best = max(best, g.kinds.get(kind, g.kinds.get(kind.rstrip("+-~"), 0.0)) * weight)
            harmless *= 1 - best
        return 1 - harmless

    got = {x.doc_id: (x.score, x.predicted) for x in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), g).collect()}
    for i, t in rows:
        assert got[i][0] == pytest.approx(brute(t)) and got[i][1] == int(brute(t) >= 0.7)


def test_repeated_label_rows_teach_once(spark, docs):
    rows, labels = toxic_corpus(5, 400)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = fit_grammar(docs(rows), marks, F.lit(True), sample=5000)
    often = fit_grammar(docs(rows), marks.unionByName(marks).unionByName(marks), F.lit(True), sample=5000)
    assert (once.entries, once.weight, once.kinds) == (often.entries, often.weight, often.kinds)


def test_lexicon_needs_evidence():
    found = candidates([("often", 40, 0), ("rare", 2, 0), ("mixed", 40, 30)], 100, 900, 1000)
    assert set(found) == {"often"}
    copies = [["often\ta\tb"]] * 40
    assert lexicon(copies, found, 1000) == {}
    assert set(lexicon([[f"often\ta{i}\tb"] for i in range(40)], found, 1000)) == {"often"}


def test_toxicity_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (None, "blarg"), (3, "x " * 100_000 + "blarg"), (4, "same"), (4, "same")]
    g = Grammar({"blarg": 0.95})
    g.kinds = {"insult": 1.0}
    got = score_toxicity(docs(rows), g).collect()
    assert len(got) == 6 and {x.doc_id for x in got if x.predicted} == {None, 3}
    assert score_toxicity(docs([]), g).count() == 0
    clash = spark.createDataFrame([(1, "blarg", "s", 2)], "doc_id long, text string, predicted string, text_to_score int")
    assert score_toxicity(clash, g).columns == ["doc_id", "text", "text_to_score", "score", "predicted"]
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_grammar(docs(rows), nothing, F.lit(True)).entries == []
