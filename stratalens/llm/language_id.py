"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector has the byte 2- and 3-grams of its lower-case letters, blanks standing for all else,
hashed to ``SIZE`` places, with logarithmic counts weighted by inverse document frequency and brought to
length 1. Each language has several centroids, from spherical k-means over a sample of its labelled
texts. A text gets the language of the centroid with the highest cosine; one that is farther from it
than the language's own texts ever are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.common import documents, free_name, hash_bound, materialise, small_batches, text_or_empty, trimmed, without

SIZE_BITS = 12
SIZE = 1 << SIZE_BITS
#: Labelled texts that are learned from, for each language; centroids of a language, and rounds of k-means.
PER_LANGUAGE, CENTROIDS, ROUNDS = 500, 4, 12
#: This part of a language's sample, the farthest from its mean, isn't clustered: mislabelled and mixed texts are there.
TRIM = 0.08
#: Starts of k-means; those in which each cluster has this part of the bulk come before others.
STARTS, LEAST_PART, SEED = 8, 0.05, 42
#: A text is rejected under this part of the cosine that 99 % of the language's texts reach.
REJECT = 0.5
UNDETERMINED = "und"

_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def grams(text: str) -> np.ndarray:
    """1 + log of the counts of the n-grams of a whole text, by place."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD), np.uint8)
    counts = np.zeros(SIZE, np.int64)
    for at in range(0, len(raw), 1 << 20):
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        keep = (part[:-1] != 32) | (part[1:] != 32)
        pairs = part[:-1] << np.uint32(8) | part[1:]
        own = pairs[: 1 << 20][keep[: 1 << 20]] | np.uint32(1 << 24)
        triples = (pairs[:-1] << np.uint32(8) | part[2:])[keep[:-1]]
        for codes in (own, triples):
            counts += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - SIZE_BITS), minlength=SIZE)
    out = np.zeros(SIZE, np.float32)
    some = counts > 0
    out[some] = 1 + np.log(counts[some])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _seeds(vectors: np.ndarray, many: int, draw: np.random.Generator) -> np.ndarray:
    """k-means++: each next one is drawn in proportion to its distance from those chosen."""
    chosen = [int(draw.integers(len(vectors)))]
    far = np.maximum(1 - vectors @ vectors[chosen[0]], 0)
    while len(chosen) < min(many, len(vectors)) and (total := far.sum(dtype=np.float64)) > 1e-6:
        chosen.append(min(int(np.searchsorted(np.cumsum(far, dtype=np.float64), draw.random() * total, side="right")), len(vectors) - 1))
        far = np.minimum(far, np.maximum(1 - vectors @ vectors[chosen[-1]], 0))
    return vectors[chosen]


def cluster(vectors: np.ndarray, many: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means++ over the bulk: of several starts the one whose smallest cluster isn't tiny, then the closest one."""
    central = vectors @ _unit(vectors.sum(axis=0))
    bulk = vectors[central >= np.quantile(central, TRIM)]
    draw, best = np.random.default_rng(SEED), None
    for _ in range(STARTS):
        centres = _seeds(bulk, many, draw)
        for _ in range(rounds):
            of = np.argmax(bulk @ centres.T, axis=1)
            centres = np.stack([_unit(bulk[of == c].sum(axis=0)) if (of == c).any() else centres[c] for c in range(len(centres))])
        cosines = bulk @ centres.T
        sizes = np.bincount(np.argmax(cosines, axis=1), minlength=len(centres))
        worth = (min(sizes.min() / len(bulk), LEAST_PART), float(cosines.max(axis=1).sum()))
        if best is None or worth > best[0]:
            best = worth, centres[sizes > 0]
    return best[1]


class LanguageModel:
    """Centroids of each language. Fitted from (language, gram counts) pairs."""

    def __init__(self, langs: list[str], counts: np.ndarray, centroids: int = CENTROIDS) -> None:
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        vectors, names = _unit(counts * self.idf), np.array(langs, object)
        self.names = sorted(set(langs))
        centres, self.of, self.least = [], [], []
        for n, lang in enumerate(self.names):
            own = vectors[names == lang]
            centres.append(cluster(own, centroids))
            self.of += [n] * len(centres[-1])
            self.least.append(REJECT * float(np.quantile((own @ centres[-1].T).max(axis=1), 0.01)))
        self.centres, self.of = (np.concatenate(centres) if centres else np.zeros((0, SIZE), np.float32)), np.array(self.of, int)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = []
        for text in texts:
            if not self.names or not has_letter(text):
                out.append((UNDETERMINED, 0.0, True))
                continue
            cosines = self.centres @ _unit(grams(text) * self.idf)
            best = np.full(len(self.names), -1.0)
            np.maximum.at(best, self.of, cosines)
            at = int(np.argmax(best))
            odds = np.exp(20 * (best - best[at]))
            out.append((self.names[at], float(1 / odds.sum()), bool(best[at] < self.least[at])))
        return out


def sample_bound(wanted: int, rows: int) -> int:
    """The hash up to which rows are drawn, so that of ``rows`` about twice ``wanted`` are, however many there are."""
    return hash_bound(2 * wanted / max(rows, 1))


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, grams(text).astype(np.float16).tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], ["lang", "grams"])


def fit_language_model(df: DataFrame, learnable: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from rows where ``learnable`` holds and the language isn't null: ``per_language`` of each at most, those with the smallest hashes of id and language. The bound holds for labelled rows alone; every text is then judged whole."""
    spark = df.sparkSession
    draw = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{lang_col}`"))
    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_or_empty(text_col).alias("text"), draw.alias("draw"), learnable.alias("ok")).where(F.col("ok") & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return LanguageModel([], np.zeros((0, SIZE), np.float32))
    bounds = spark.createDataFrame([(r["lang"], sample_bound(per_language, r["count"])) for r in sizes], "lang string, bound long")
    near = rows.join(F.broadcast(bounds), "lang").where("draw <= bound").select("lang", "text", "draw")  # a row for each language
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))  # of twice per_language rows or so
    chosen = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("lang", "text")
    with small_batches(spark, 200):
        found = materialise(chosen.mapInArrow(trimmed(_sample_grams), "lang string, grams binary"), "grams").orderBy("lang", "grams").collect()
    counts = np.stack([np.frombuffer(r.grams, np.float16).astype(np.float32) for r in found]) if found else np.zeros((0, SIZE), np.float32)
    return LanguageModel([r.lang for r in found], counts)


def _predict(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.predict(batch.column(at).to_pylist())
            lang, score, rejected = zip(*found) if found else ((), (), ())
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*(batch.schema.names[i] for i in keep), "lang_pred", "score", "rejected"])

    return run


def identify_language(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` and lang_pred, score (0 to 1) and rejected.

    A text without a letter, or null, is ``und`` with score 0, and rejected; so is every text if no
    language has been learned. Other texts get the nearest language, and are rejected as well if they
    are too far from it. Very long texts are read whole. Ties: of equal cosines the language that comes
    first by name. Rows are judged by text alone; repeated rows alike. An empty table gives an empty
    result. Existing columns called lang_pred, score or rejected are replaced; others stay.
    """
    whole = without(df, "lang_pred", "score", "rejected")
    name = free_name(whole, "text_to_identify")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in whole.schema.fields)
    share = df.sparkSession.sparkContext.broadcast(model)
    return whole.withColumn(name, F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(_predict(share, len(whole.columns))), f"{fields}lang_pred string, score double, rejected boolean")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit_language_model(docs, ~held_out)
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
