"""Files of token ids in directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 has the lowest chunk of every token, and a bitmap that says
which tokens go on; level 1 has the next chunk of those, and so on. A rank directory counts the bits
that are set before every 512th, so the place of a token's chunk on the next level takes one look-up
and a count within 64 bytes: any token is read by itself, and no block is decoded.

A file: the 8 bytes ``SLDAC001``; the length of the header (unsigned 64 bits, little-endian); the
header (JSON: documents, tokens, and kind, place and size of each array); the arrays, each from a
multiple of 8 bytes on: ``doc_id`` and ``known`` (0: the id is null), ``ends`` (tokens up to the end
of each document), and for each level ``chunk``, ``more`` and ``rank``.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.common import documents, materialise, new_path, shuffle_width, small_batches, text_or_empty, trimmed
from stratalens.llm.tokens import encoder

MAGIC, CHUNK, SPAN = b"SLDAC001", 8, 512
#: Tokens after which a task begins another file, bytes of text that a task has, about.
FILE_TOKENS, PART_BYTES = 2_000_000, 128_000_000
#: Pieces that an encoder's table holds: not many, as its task sorts whole texts as well.
KNOWN = 450_000


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """The file with these tokens and documents."""
    arrays: list[tuple[str, np.ndarray]] = [
        ("doc_id", np.array([d or 0 for d in doc_ids], "<i8")),
        ("known", np.array([d is not None for d in doc_ids], np.uint8)),
        ("ends", np.cumsum(counts, dtype="<i8") if counts else np.zeros(0, "<i8")),
    ]
    left, level = ids.astype(np.uint32), 0
    while level == 0 or len(left):
        more = left >> CHUNK > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (SPAN // 8), np.uint8)])
        spans = np.bitwise_count(bits).reshape(-1, SPAN // 8).sum(axis=1, dtype=np.int64)
        arrays += [(f"chunk{level}", (left & 0xFF).astype(np.uint8)), (f"more{level}", bits), (f"rank{level}", (np.cumsum(spans) - spans).astype("<i8"))]
        left, level = left[more] >> CHUNK, level + 1
    table, body, at = {}, [], 0
    for name, array in arrays:
        raw = array.tobytes()
        table[name] = [array.dtype.str, at, len(array)]
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    header = json.dumps({"documents": len(doc_ids), "tokens": len(ids), "levels": level, "arrays": table}).encode()
    header += b" " * (-(len(header) + 16) % 8)
    return b"".join([MAGIC, struct.pack("<Q", len(header)), header, *body])


class TokenFile:
    """Reads a file through an object with read_at(bytes, place), such as an Arrow input file; only what is asked for."""

    def __init__(self, source) -> None:
        self.source = source
        lead = source.read_at(16, 0)
        if lead[:8] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<Q", lead[8:])[0]
        self.header = json.loads(source.read_at(size, 16))
        self.begin, self.levels = 16 + size, self.header["levels"]
        self.tokens = self.header["tokens"]

    def part(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        kind, at, n = self.header["arrays"][name]
        dtype = np.dtype(kind)
        start, stop = min(start, n), n if stop is None else min(stop, n)
        return np.frombuffer(self.source.read_at((stop - start) * dtype.itemsize, self.begin + at + start * dtype.itemsize), dtype)

    def rank(self, level: int, i: int) -> int:
        """How many of the tokens before ``i`` on this level go on."""
        span = i // SPAN
        bits = self.part(f"more{level}", span * SPAN // 8, (i + 7) // 8)
        some = np.unpackbits(bits, bitorder="little")[: i - span * SPAN]
        directory = self.part(f"rank{level}", span, span + 1)
        return (int(directory[0]) if len(directory) else int(np.bitwise_count(self.part(f"more{level}")).sum())) + int(some.sum())

    def token(self, i: int) -> int:
        """The ``i``-th token, read by itself."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop``: one stretch of each level."""
        return self._level(0, start, stop)

    def _level(self, level: int, start: int, stop: int) -> np.ndarray:
        out = self.part(f"chunk{level}", start, stop).astype(np.uint32)
        if start >= stop or level + 1 >= self.levels:
            return out
        bits = np.unpackbits(self.part(f"more{level}", start // 8, (stop + 7) // 8), bitorder="little")
        more = bits[start % 8 : start % 8 + stop - start].astype(bool)
        if more.any():
            at = self.rank(level, start)
            out[more] |= self._level(level + 1, at, at + int(more.sum())) << np.uint32(CHUNK)
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens of the file before it, ids) of each document."""
        ids, start = self.slice(0, self.tokens), 0
        for doc, known, end in zip(self.part("doc_id").tolist(), self.part("known").tolist(), self.part("ends").tolist()):
            yield doc if known else None, start, ids[start:end]
            start = end


def open_file(uri: str) -> TokenFile:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return TokenFile(system.open_input_file(path))


_WRITTEN = "part int, nth int, path string, documents long, tokens long, bytes long"


def _write(folder: str, path: str, end_id: int, file_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many, end, part, nth = encoder(path, KNOWN).encode_many, np.array([end_id], np.uint32).tobytes(), TaskContext.get().partitionId(), 0
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        docs: list[int | None] = []
        counts: list[int] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{nth:05d}.dac"
            raw = to_bytes(np.frombuffer(b"".join(ids), np.uint32), docs, counts)
            attempt = f"{root}/_{uuid.uuid4().hex}"
            with system.open_output_stream(attempt) as out:
                out.write(raw)
            system.move(attempt, f"{root}/{name}")  # whole or not at all, even if two attempts write it
            row = (part, nth, f"{folder}/{name}", len(docs), held, len(raw))
            docs.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), encode_many(batch.column(1).to_pylist())):
                docs.append(doc)
                ids.append(own + end)
                counts.append(len(ids[-1]) // 4)
                held += counts[-1]
                if held >= file_tokens:
                    yield close()
                    held, nth = 0, nth + 1
        if docs:
            yield close()

    return run


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the id; one row for each file: path, documents, tokens, bytes, start.

    ``folder`` is a URI that the driver and all executors reach. ``start`` is the number of tokens in
    the files before: a running sum over the tasks, and one over the files of each. Rows with a null id
    come first; rows with one id in the order of their texts' hashes, repeated rows each. A null text
    counts as empty. A very long text is one document of one file, whatever ``file_tokens`` is. An empty
    table writes no file. Other columns are ignored, whatever their names.
    """
    spark, text = df.sparkSession, text_or_empty(text_col)
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(2 * shuffle_width(spark), size // PART_BYTES + 1), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    with small_batches(spark):
        # shuffled, so that the rows of many tasks are few Parquet files: on a local file system without Hadoop's native library the JVM starts three processes for each
        files = materialise(dealt.mapInArrow(trimmed(_write(folder, tokenizer_path, end_id, file_tokens)), _WRITTEN).repartition("part"), "token-files")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("base"))  # a row for each task
    within = files.withColumn("within", before(Window.partitionBy("part").orderBy("nth")))
    return within.join(parts, "part").select("path", "documents", "tokens", "bytes", (F.col("base") + F.col("within")).alias("start"))


def _read(with_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc, start, ids in open_file(path).documents():
                    row = (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.astype(np.int64)) if with_ids else row)
                for at in range(0, len(rows), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 5_000]), schema)], schema=schema)

    return run


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the files that ``write_token_files`` has named: doc_id, start, n_tokens, ids_crc32 [, ids]."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = files.select("path", "start").repartition(shuffle_width(files.sparkSession), F.xxhash64("path"))
    return spread.mapInArrow(trimmed(_read(with_ids)), schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(documents(spark, sf_dir), new_path(spark, "dac"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(files)
