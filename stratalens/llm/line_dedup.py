"""Removal of lines that many documents repeat, with two Bloom filters ahead of the exact count.

First pass: every task enters the hashes of its documents' lines in a filter ``once``; a hash that is
there already goes into ``twice`` as well. Filters are merged segment by segment, in a tree: what stands
in both of two ``once`` filters has been seen twice. No line that occurs in two documents is missing
from the merged ``twice``. Second pass: only lines found there travel further, with the SHA-256 of their
key, counted in advance within each task; documents are then counted exactly, and the first occurrence
is chosen where one is to stay. Third pass: the keys that lose their lines go to all tasks if they are
few (their number is checked), and no text is shuffled; otherwise the lines to drop are joined to their
rows. The filters are sized from a count of the lines, up to ``bloom.MOST_BITS``; on larger corpora more lines
are suspected, which costs shuffle but never changes the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.bloom import SEGMENT_SQL, entered, filter_bits_for, loaded, seen_twice
from stratalens.llm.common import documents, free_name, materialise, small_batches, tell_entries, text_or_empty, trimmed, with_entry_ids, without

#: Keys that are sent to all tasks, at most; with more the lines to drop are joined to their rows.
SENT_KEYS = 500_000
#: Occurrences that a task gathers before it writes entries, and occurrences in an entry at most.
FLUSH, ENTRY = 200_000, 500
BLANK = b" \t\n\x0b\x0c\r"

_ENTRY = pa.schema([("digest", pa.binary()), ("n_docs", pa.int64()), ("row_a", pa.list_(pa.int64())), ("row_b", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("first_id", pa.int64()), ("first_a", pa.int64()), ("first_b", pa.int64()), ("first_at", pa.int32()), ("probe", pa.int64())])


def line_keys(text: str | None) -> list[bytes]:
    """The keys of the lines of a text: blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def _fill(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh64_intdigest

        def hashes() -> Iterator[np.ndarray]:
            held: list[int] = []
            for batch in batches:
                for text in batch.column(0):
                    held += {hashed(k) for k in line_keys(text.as_py()) if _long_enough(k, least)}
                    if len(held) > 500_000:
                        yield np.array(held, np.uint64)
                        held = []
            if held:
                yield np.array(held, np.uint64)

        yield from entered(hashes(), bits)

    return run


def _first(a: tuple, b: tuple) -> tuple:
    """The earlier of two (id, row_a, row_b, line): null ids come last."""
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    return min(a, b, key=order)


def _suspects(bits: int, least: int, twice_packed, with_rows: bool):
    """Entries of the suspected lines of a task: how many documents have one, and its first occurrence; ``with_rows``: all its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hashed = loaded(twice_packed.value, bits), xxhash.xxh64_intdigest
        groups: dict[tuple[bytes, int], list[tuple]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for (digest, probe), found in groups.items():
                told = None
                for at in range(0, len(found), ENTRY):
                    some = found[at : at + ENTRY]
                    first, n = some[0][:4], 0
                    for x in some:
                        n += x[4] != told  # a document's occurrences stand together
                        told = x[4]
                        first = _first(first, x[:4])
                    ids, a, b, line, _ = zip(*some)
                    rows.append((digest, n, *((a, b, line) if with_rows else (None, None, None)), *first, probe))
            for at in range(0, len(rows), 5_000):
                cols = zip(*rows[at : at + 5_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRY)], schema=_ENTRY)

        number = 0
        for batch in batches:
            for text, doc, a, b in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                number += 1
                keys = line_keys(text.as_py())
                hashes = np.array([hashed(k) for k in keys], np.uint64)
                found = np.flatnonzero(twice.has(twice.places(hashes)))
                for line, probe in zip(found.tolist(), hashes[found].view(np.int64).tolist()):
                    if _long_enough(keys[line], least):
                        groups.setdefault((hashlib.sha256(keys[line]).digest(), probe), []).append((doc, a, b, line, number))
                        held += 1
            if held > FLUSH:
                yield from flush()
                groups.clear()
                held = 0
        yield from flush()

    return run


_SUSPECT_SQL = "digest binary, n_docs long, row_a array<long>, row_b array<long>, at array<int>, first_id long, first_a long, first_b long, first_at int, probe long"


def _without_lines(sent, at: int, text_at: int, names: list[str], keep_first: bool):
    """Of rows whose column ``at`` is the text and the next two its key: the columns before, with the text less the lines that ``sent`` names, and the two counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, hashed = sent.value, xxhash.xxh64_intdigest
        short = {h for h, _ in gone}
        for batch in batches:
            texts, counts, dropped = [], [], []
            places = zip(batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist())
            for text, place in zip(batch.column(at), places):
                text = text.as_py()
                lines, left = text.split("\n"), []
                for n, (line, key) in enumerate(zip(lines, line_keys(text))):
                    h = hashed(key)
                    first = gone.get((h, hashlib.sha256(key).digest())) if h in short else None
                    if first is None or (keep_first and first == (*place, n)):
                        left.append(line)
                counts.append(len(lines))
                dropped.append(len(lines) - len(left))
                texts.append("\n".join(left) if dropped[-1] else text)
            kept = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(kept if i == text_at else batch.column(i) for i in range(at)), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def _keys_of(rows: list) -> dict[tuple[int, bytes], tuple]:
    return {(r.probe & (1 << 64) - 1, bytes(r.digest)): (r.first.first_a, r.first.first_b, r.first.first_at) for r in rows}


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int | None = None, sent_keys: int = SENT_KEYS) -> DataFrame:
    """``df`` with lines gone from its text, and the columns n_lines (before) and n_dropped.

    Lines are the parts between \\n. A key is the line with blanks ([\\x20\\x09-\\x0D]) stripped at both
    ends and A-Z lower-cased. Keys of at least ``min_chars`` code points that are in at least
    ``min_docs`` rows lose all their lines (``keep="none"``) or all but the first (``keep="first"``: the
    smallest id, then line). What stays is joined by \\n. ``filter_bits``: the filters' size as a power
    of two; None: from the number of lines.

    Nulls: a null text counts as empty, that is one empty line, and becomes empty; a null id comes
    last. Very long texts are read whole, line by line, in one task each. Ties of ids go to the row whose
    key (two hashes of id and text) is smaller. Each row counts as a document, so repeated rows count
    each time, and lose the same lines. An empty table gives an empty result. Existing columns called
    n_lines or n_dropped are replaced; other columns stay, whatever their names.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = df.sparkSession
    text = text_or_empty(text_col)
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    bits = filter_bits_for(df.agg(F.sum(n_lines)).first()[0] or 0) if filter_bits is None else filter_bits
    twice = seen_twice(df.select(text.alias("text")).mapInArrow(trimmed(_fill(bits, min_chars)), SEGMENT_SQL), bits)

    doc = F.col(f"`{id_col}`").cast("long")
    row_a, row_b = F.xxhash64(doc, text), F.xxhash64(text, F.lit(1), doc)
    read = df.select(text.alias("text"), doc.alias("id"), row_a.alias("a"), row_b.alias("b"))
    suspected = lambda with_rows: read.mapInArrow(trimmed(_suspects(bits, min_chars, twice, with_rows)), _SUSPECT_SQL)
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_a", "first_b", "first_at"))
    probe = F.min("probe").alias("probe")
    counted = suspected(False).select("digest", "n_docs", "first_id", "first_a", "first_b", "first_at", "probe")
    with small_batches(spark):
        confirmed = materialise(counted.groupBy("digest").agg(F.sum("n_docs").alias("n"), first.alias("first"), probe).where(F.col("n") >= min_docs), "confirmed")

    whole = without(df, "n_lines", "n_dropped")
    names = whole.columns
    if confirmed.limit(sent_keys + 1).count() <= sent_keys:
        share = spark.sparkContext.broadcast(_keys_of(confirmed.select("digest", "probe", "first").collect()))  # sent_keys at most
        a, b, asked = (free_name(whole, x) for x in ("line_row_a", "line_row_b", "line_text"))
        text_at = [c.lower() for c in names].index(text_col.lower())
        fields = "".join(f"`{f.name}` {'string' if i == text_at else f.dataType.simpleString()}, " for i, f in enumerate(whole.schema.fields))
        rows = whole.select(*(F.col(f"`{c}`") for c in names), text.alias(asked), row_a.alias(a), row_b.alias(b))
        return rows.mapInArrow(trimmed(_without_lines(share, len(names), text_at, names, keep == "first")), f"{fields}n_lines long, n_dropped long")

    with small_batches(spark):
        entries = materialise(with_entry_ids(suspected(True).select("digest", "row_a", "row_b", "at")), "suspects")
    gone = tell_entries(entries, confirmed.select("digest", "first"), ["digest"])
    gone = gone.select("first", F.explode(F.arrays_zip("row_a", "row_b", "at")).alias("row"))
    if keep == "first":
        gone = gone.where((F.col("row.row_a") != F.col("first.first_a")) | (F.col("row.row_b") != F.col("first.first_b")) | (F.col("row.at") != F.col("first.first_at")))
    a, b, ga, gb, lines, left, dropped_at = (free_name(whole, x) for x in ("line_row_a", "line_row_b", "gone_row_a", "gone_row_b", "line_parts", "line_left", "lines_gone"))
    gone = gone.groupBy(F.col("row.row_a").alias(ga), F.col("row.row_b").alias(gb)).agg(F.collect_list("row.at").alias(dropped_at))
    joined = whole.withColumn(a, row_a).withColumn(b, row_b).join(gone, (F.col(a) == F.col(ga)) & (F.col(b) == F.col(gb)), "left")
    parts = joined.withColumn(lines, F.split(text, "\n", -1)).withColumn(left, F.when(F.col(dropped_at).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped_at))))
    kept = F.when(F.col(left).isNull(), text).otherwise(F.array_join(F.transform(F.col(left), lambda i: F.get(F.col(lines), i)), "\n"))
    dropped = F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left))
    return parts.select(*(kept.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in names), n_lines.alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, lower_az AS key
  FROM (
    SELECT doc_id, i, parts, translate(regexp_replace(regexp_replace(parts[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) AS d, unnest(range(1, len(parts) + 1)) AS u(i)
  )
), common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE common.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key)
GROUP BY doc_id
"""
