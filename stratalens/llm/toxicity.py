"""Toxicity by a weighted grammar of finite-state patterns over clauses.

The lexical transducer reads the words of a clause and writes classes: insults, threats, targets (as
subject or object), negations, verbs of reported speech. A marker picks one insult or threat of the
clause. Four more transducers each tell one thing of it: whether the clause has a target, on either side;
for a threat, whether there is an object before the verb, in it or a target after it; whether a negation
stands within reach before or after; and whether a reporting verb does. As what comes after isn't known
when the event is read, each of them guesses, and accepts only if the rest of the clause bears the guess
out. They are composed by the product construction into one machine whose paths through a clause are its
matches. A match weighs as much as its lexicon entry and its kind have proved right in the labelled
sample; a clause counts by its heaviest path; the score is the probability that not every clause is
harmless.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import documents, free_name, materialise, small_batches, text_or_empty, trimmed, without
from stratalens.llm.language_id import fold, sample_bound

#: Labelled rows that are learned from at most; lengths of stems.
SAMPLE, STEMS = 20_000, (4, 5, 6)
#: An entry's texts must be toxic to this part at least; score from which a text is predicted toxic.
PURE, THRESHOLD = 0.9, 0.7
#: Words that a negation or a reporting verb reaches, forward and back.
REACH = 4
#: What a listed insult weighs before any text is seen, and as how many texts that counts.
LISTED, LISTED_TEXTS = 0.85, 2

# Function words, verbs and insults, in English, German, French and Spanish.
SUBJECTS = "your yours yourself he his she their du dein deine er tu ton ta tes votre vos il elle ils elles tú él ella ellos ellas".split()
OBJECTS = "you him her them people everyone dich dir euch ihr sie ihn ihm leute te toi vous lui leur gens ti usted ustedes gente".split()
NEGATIONS = "not no never none nobody nothing isn aren wasn weren don doesn didn won wouldn shouldn cannot nicht kein keine keinen nie niemals nichts ne pas jamais aucun aucune rien sin nunca jamás ningún ninguna nada".split()
REPORTS = "said says say told tells wrote writes called calls claimed claims reported reports quoted quotes according sagte sagt schrieb schreibt nannte nennt behauptete laut dit disait écrit appelle appelait affirme selon dijo dice escribió llamó llama afirmó según".split()
THREATS = "kill kills killing murder hurt destroy beat burn shoot stab strangle töten töte umbringen schlagen verletzen zerstören verbrennen sterben tuer tuerai frapper détruire brûler mourir matar mataré golpear destruir quemar morir".split()
INSULTS = "idiot idiots idiotic moron morons stupid dumb fool fools loser losers worthless pathetic scum trash garbage jerk imbecile clown coward liar disgusting trottel dumm dummkopf blöd blödmann versager abschaum wertlos erbärmlich schwachkopf depp feigling lügner imbécile stupide crétin débile abruti minable ordure connard menteur lâche idiota idiotas estúpido estúpida imbécil tonto inútil basura escoria patético cretino cobarde mentiroso".split()
#: Object pronouns that Spanish writes in one word with an infinitive.
CLITICS = "te os lo la los las le les".split()

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
#: Classes of words. An insult's symbol in a text is INSULT + its number in the lexicon; AIMED is a threat with its object in one word.
OTHER, END, SUBJECT, OBJECT, NEGATION, REPORT, THREAT, AIMED, INSULT = range(9)
CLASSES = (OTHER, SUBJECT, OBJECT, NEGATION, REPORT, THREAT, AIMED, INSULT)
_TARGETS, _EVENTS = (SUBJECT, OBJECT, AIMED), {THREAT: "threat", AIMED: "threat", INSULT: "insult"}


@dataclass
class Transducer:
    """``step``: of a state and a symbol, (symbol written, next state) for each arc. A symbol is (class, kind): kind is empty but for the marked event."""

    start: object
    step: Callable[[object, tuple[int, str]], list[tuple[tuple[int, str], object]]]
    final: Callable[[object], bool]


def _marker() -> Transducer:
    """Marks one event of the clause, each on a path of its own."""

    def step(state, symbol):
        arcs = [(symbol, state)]
        if state == "before" and symbol[0] in _EVENTS:
            arcs.append(((symbol[0], _EVENTS[symbol[0]]), "after"))
        return arcs

    return Transducer("before", step, lambda state: state == "after")


def _target() -> Transducer:
    """Writes + to a marked insult if the clause has a target anywhere."""

    def step(state, symbol):
        here = symbol[0] in _TARGETS
        if symbol[1]:
            if symbol[1] != "insult":
                return [(symbol, "done")]
            if state == "seen":
                return [((symbol[0], symbol[1] + "+"), "done")]
            return [((symbol[0], symbol[1] + "+"), "need"), (symbol, "forbid")]
        if not here:
            return [(symbol, state)]
        return [] if state == "forbid" else [(symbol, {"none": "seen", "need": "done"}.get(state, state))]

    return Transducer("none", step, lambda state: state in ("done", "forbid"))


def _aim() -> Transducer:
    """Accepts a marked threat only with an object before it, in it, or a target after it."""

    def step(state, symbol):
        if symbol[1]:
            aimed = symbol[1][0] != "t" or symbol[0] == AIMED or state == "object"
            return [(symbol, "done" if aimed else "need")]
        if state == "none" and symbol[0] == OBJECT:
            return [(symbol, "object")]
        if state == "need" and symbol[0] in _TARGETS:
            return [(symbol, "done")]
        return [(symbol, state)]

    return Transducer("none", step, lambda state: state == "done")


def _within_reach(of: int, sign: str, reach: int = REACH) -> Transducer:
    """Writes ``sign`` to the marked event if a word of class ``of`` stands at most ``reach`` words before or after it."""

    def step(state, symbol):
        name, left = state
        if symbol[1]:
            if name == "before" and left:
                return [((symbol[0], symbol[1] + sign), ("done", 0))]
            return [((symbol[0], symbol[1] + sign), ("need", reach)), (symbol, ("forbid", reach))]
        here = symbol[0] == of
        if name == "before":
            return [(symbol, ("before", reach if here else max(0, left - 1)))]
        if name == "need":
            return [(symbol, ("done", 0))] if here else [(symbol, ("need", left - 1))] if left > 1 else []
        if name == "forbid":
            return [] if here else [(symbol, ("forbid", left - 1) if left > 1 else ("done", 0))]
        return [(symbol, state)]

    return Transducer(("before", 0), step, lambda state: state[0] in ("done", "forbid"))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The product: what ``a`` writes, ``b`` reads."""

    def step(state, symbol):
        p, q = state
        return [(z, (p2, q2)) for y, p2 in a.step(p, symbol) for z, q2 in b.step(q, y)]

    return Transducer((a.start, b.start), step, lambda state: a.final(state[0]) and b.final(state[1]))


class Machine:
    """A composed transducer as tables, less the states that no clause's end can be reached from."""

    def __init__(self, whole: Transducer) -> None:
        number, order, arcs = {whole.start: 0}, [whole.start], []
        for state in order:
            own = {}
            for c in CLASSES:
                for (_, kind), after in whole.step(state, (c, "")):
                    if after not in number:
                        number[after] = len(order)
                        order.append(after)
                    own.setdefault(c, []).append((kind, number[after]))
            arcs.append(own)
        self.final = {n for n, state in enumerate(order) if whole.final(state)}
        alive, grown = set(self.final), True
        while grown:
            more = {n for n, own in enumerate(arcs) if n not in alive and any(after in alive for found in own.values() for _, after in found)}
            alive |= more
            grown = bool(more)
        self.arcs = [{c: [x for x in found if x[1] in alive] for c, found in own.items()} for own in arcs]

    def matches(self, classes: list[int]) -> list[tuple[int, str]]:
        """(place, kind) of the marked event of each path that the clause's end accepts."""
        paths: list[tuple[int, int, str]] = [(0, -1, "")]
        for place, c in enumerate(classes):
            paths = [(after, place, kind) if kind else (after, at, was) for state, at, was in paths for kind, after in self.arcs[state].get(c, ())]
        return sorted((at, kind) for state, at, kind in paths if state in self.final)


def composed() -> Transducer:
    return reduce(compose, [_marker(), _target(), _aim(), _within_reach(NEGATION, "-"), _within_reach(REPORT, "~")])


@lru_cache(maxsize=1)
def machine() -> Machine:
    return Machine(composed())


class Grammar:
    """The lexical transducer with its weights, and the weights of the kinds of matches."""

    def __init__(self, lexicon: dict[str, float] | None = None) -> None:
        #: Words as they are; stems as a word's beginning and "*". The value: how often such texts are toxic.
        self.entries = list(lexicon or {})
        self.weight = [float(w) for w in (lexicon or {}).values()]
        self.words = {w: kind for kind, words in ((SUBJECT, SUBJECTS), (OBJECT, OBJECTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}
        self.words |= {verb + clitic: AIMED for verb in THREATS if verb.endswith(("ar", "er", "ir")) for clitic in CLITICS}
        self.words |= {mark: END for mark in ".!?;\n"}
        self.stems: dict[str, int] = {}
        for n, entry in enumerate(self.entries):
            if entry.endswith("*"):
                self.stems[entry[:-1]] = INSULT + n
            else:
                self.words[entry] = INSULT + n
        self.kinds: dict[str, float] = {}
        self.base = 0.0
        self._met: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_met": {}}

    def symbol(self, word: str) -> int:
        """What the lexical transducer writes for a word: of several entries the heaviest."""
        own = self.words.get(word, OTHER)
        if self.stems and own not in (END,):
            for n in STEMS:
                found = self.stems.get(word[:n]) if len(word) >= n else None
                if found is not None and (own < INSULT or self.weight[found - INSULT] > self.weight[own - INSULT]):
                    own = found
        if len(self._met) > 100_000:
            self._met.clear()
        self._met[word] = own
        return own

    def symbols(self, text: str) -> list[int]:
        words = TOKEN.findall(text.lower())
        found = list(map(self._met.get, words))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self.symbol(words[at])
        except ValueError:
            return found

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """For each clause that has any, its matches: (kind, weight of the entry)."""
        symbols = self.symbols(text)
        if not symbols or max(symbols) < THREAT:
            return
        begin = 0
        while begin < len(symbols):
            try:
                end = symbols.index(END, begin)
            except ValueError:
                end = len(symbols)
            own = symbols[begin:end]
            if own and max(own) >= THREAT:
                found = [(kind, self.weight[own[at] - INSULT] if own[at] >= INSULT else 1.0) for at, kind in machine().matches([min(s, INSULT) for s in own])]
                if found:
                    yield found
            begin = end + 1

    def score(self, text: str | None) -> float:
        harmless = 1.0 - self.base
        for found in self.clauses(text or ""):
            harmless *= 1.0 - max(self.kinds.get(kind, self.kinds.get(kind.rstrip("+-~"), 0.0)) * weight for kind, weight in found)
        return min(1.0, max(0.0, 1.0 - harmless))


def terms(text: str) -> set[str]:
    """A text's words and stems, each once."""
    words = set(re.findall(r"[^\W\d_]{2,}", text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


_TERMS = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _counts(read, wanted=None):
    """Rows (term, toxic, clean): in how many texts of a task ``read`` finds a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def give() -> Iterator[pa.RecordBatch]:
            for side, some in enumerate(counts):
                items = list(some.items())
                for at in range(0, len(items), 50_000):
                    term, n = zip(*items[at : at + 50_000])
                    zero = [0] * len(n)
                    yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), *(pa.array(c, pa.int64()) for c in ((n, zero) if side == 0 else (zero, n)))], schema=_TERMS)
                some.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = read(text.as_py())
                counts[0 if toxic else 1].update(found if wanted is None else found & wanted.value)
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield from give()
        yield from give()

    return run


def candidates(counts: list[tuple[str, int, int]], toxic: int, clean: int, vocabulary: int) -> dict[str, tuple[float, float]]:
    """(gain, weight) of the terms that are toxic beyond chance: the log-likelihood ratio exceeds what the best of ``vocabulary`` terms reaches by chance."""
    prior, found = toxic / (toxic + clean), {}
    for term, pos, neg in counts:
        share = pos / (pos + neg)
        if share >= PURE:
            gain = pos * math.log(share / prior) + (neg * math.log((1 - share) / (1 - prior)) if neg else 0.0)
            if gain > math.log(max(vocabulary, 2)) + 3:
                found[term] = (gain, (pos + prior) / (pos + neg + 1))
    return found


def occurrences(text: str, named: set[str]) -> list[str]:
    """For each occurrence of a candidate: the term, and the words before and after it."""
    words = re.findall(r"[^\W\d_]{2,}", text.lower())
    around = ["", *words, ""]
    out = set()
    for n, w in enumerate(words):
        for t in (w, *(f"{w[:k]}*" for k in STEMS if len(w) >= k)):
            if t in named:
                out.add(f"{t}\t{around[n]}\t{around[n + 2]}")
    return sorted(out)


def lexicon(texts: list[list[str]], found: dict[str, tuple[float, float]], vocabulary: int) -> dict[str, float]:
    """The candidates that stay beyond chance if only different surroundings count (copies of a text give all its words the same ones); of words and stems that say the same, one."""
    texts_of: dict[str, set[int]] = {}
    around: dict[str, set[str]] = {}
    for n, own in enumerate(texts):
        for x in own:
            term, where = x.split("\t", 1)
            texts_of.setdefault(term, set()).add(n)
            around.setdefault(term, set()).add(where)
    least = math.log(max(vocabulary, 2)) + 3
    strong = [t for t, own in texts_of.items() if found[t][0] * min(1.0, len(around[t]) / len(own)) > least]
    strong.sort(key=lambda t: (-len(texts_of[t]), t.endswith("*"), -len(t), t))
    chosen: dict[str, float] = {}
    for t in strong:
        bare = t.rstrip("*")
        wider = any(f"{bare[:k]}*" in chosen for k in STEMS if k <= len(bare))
        same = t.endswith("*") and any(c.rstrip("*").startswith(bare) and len(texts_of[c]) >= 0.95 * len(texts_of[t]) for c in chosen)
        if not wider and not same:
            chosen[t] = found[t][1]
    return chosen


def with_listed(chosen: dict[str, float], counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """The learned entries and the listed insults that they don't cover, weighed by what the sample says of them."""
    seen = {term: (pos, neg) for term, pos, neg in counts}
    out = dict(chosen)
    for word in INSULTS:
        if word not in out and not any(f"{word[:k]}*" in chosen for k in STEMS if k <= len(word)):
            pos, neg = seen.get(word, (0, 0))
            out[word] = (pos + LISTED * LISTED_TEXTS) / (pos + neg + LISTED_TEXTS)
    return out


def fit_grammar(df: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """Learn lexicon and weights from ``sample`` rows at most of ``labels`` (doc_id, toxic) where ``learnable`` holds, those with the smallest hashes of the id.

    Without toxic or without clean rows the lexicon is empty. Repeated rows of labels, and copies of a
    text, teach once.
    """
    spark = df.sparkSession
    known = labels.where(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("labelled_id"), (F.col("toxic") == 1).alias("toxic"))
    draw = F.xxhash64("labelled_id")
    drawn = known.where(draw <= sample_bound(sample, known.count())).orderBy(draw, "labelled_id", "toxic").limit(sample).distinct()
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("labelled_id"), text_or_empty(text_col).alias("text"))
    texts = texts.join(F.broadcast(drawn), "labelled_id").select("text", "toxic")
    schema = "term string, toxic long, clean long"
    totals = lambda found: found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    with small_batches(spark):
        texts = materialise(texts.withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "toxic"]).select("text", "toxic"), "labelled")  # copies teach once
        sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
        if not toxic or not clean:
            return Grammar()
        prior = toxic / (toxic + clean)
        least = max(2, math.ceil(8 / -math.log(prior)))
        seen = materialise(totals(texts.where("toxic").mapInArrow(trimmed(_counts(terms)), schema)), "terms")
        vocabulary = seen.count()
        often = seen.where((F.col("toxic") >= least) | F.col("term").isin(INSULTS))
        wanted = spark.sparkContext.broadcast({r.term for r in often.select("term").collect()} | set(INSULTS))  # terms of the sample
        counted = [tuple(r) for r in totals(texts.mapInArrow(trimmed(_counts(terms, wanted)), schema)).collect()]
        found = candidates(counted, toxic, clean, vocabulary)
        named = spark.sparkContext.broadcast(set(found))

        def candidates_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([occurrences(t.as_py(), named.value) for t in batch.column(0)], pa.list_(pa.string()))], ["terms"])

        has = [r.terms for r in texts.where("toxic").select("text").mapInArrow(trimmed(candidates_in), "terms array<string>").collect()]  # of the sample
        grammar = Grammar(with_listed(lexicon(has, found, vocabulary), counted))
        share = spark.sparkContext.broadcast(grammar)

        def kinds(text: str) -> set[str]:
            found = {kind for clause in share.value.clauses(text) for kind, _ in clause}
            return found | {k.rstrip("+-~") for k in found} or {""}

        for kind, pos, neg in totals(texts.mapInArrow(trimmed(_counts(kinds)), schema)).collect():
            if kind:
                grammar.kinds[kind] = max(0.0, ((pos + prior) / (pos + neg + 1.0) - prior) / (1 - prior))  # beyond the share of all texts
            else:
                grammar.base = min(0.5, pos / (pos + neg + 1.0))
    return grammar


def _score(grammar, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grammar.value
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(at)]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*(batch.schema.names[i] for i in keep), "score", "predicted"])

    return run


def score_toxicity(df: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` and score (0 to 1) and predicted (1 if score >= threshold, else 0) of each whole text.

    Null and empty texts have the score of a text without matches. Very long texts are read whole, clause
    by clause. Ties: of matches that weigh the same either may count, as the score is the same. Rows are
    judged by text alone; repeated rows alike. An empty table gives an empty result. Existing columns
    called score or predicted are replaced; others stay.
    """
    whole = without(df, "score", "predicted")
    name = free_name(whole, "text_to_score")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in whole.schema.fields)
    share = df.sparkSession.sparkContext.broadcast(grammar)
    return whole.withColumn(name, text_or_empty(text_col)).mapInArrow(trimmed(_score(share, len(whole.columns), threshold)), f"{fields}score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    grammar = fit_grammar(docs, labels, ~held_out)
    found = score_toxicity(docs.select("doc_id", "text"), grammar)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
