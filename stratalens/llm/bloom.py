"""Two Bloom filters that tell what has been seen once and twice, filled by many tasks and merged."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import shuffle_width, small_batches, trimmed

#: Bits of a filter for each hash; its size in bits as a power of two, at least and at most. So the broadcast filter has 128 MB at most.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 16, 20, 30
#: Bits of a segment, as a power of two, at least, and segments of a filter at most, so too; a hash lies in one segment only.
SEGMENT_BITS, SEGMENTS = 17, 9
#: Tasks whose filters one task merges at a time, in the first round.
FAN_IN = 32

_SEGMENT = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
SEGMENT_SQL = "segment int, once binary, twice binary"


def filter_bits_for(hashes: int) -> int:
    """The filter's size for so many hashes, as a power of two."""
    return min(max((BITS_A_LINE * max(hashes, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def segment_bits(bits: int) -> int:
    return min(bits, max(SEGMENT_BITS, bits - SEGMENTS))


class Filter:
    """A Bloom filter in which a hash has three bits, all in one segment."""

    def __init__(self, bits: int) -> None:
        self.bits, self.data = bits, np.zeros(1 << bits >> 3, np.uint8)
        self.part = segment_bits(bits)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << self.part) - 1)
        first, step = hashes & low, (hashes >> np.uint64(32)) | np.uint64(1)
        spread = hashes * np.uint64(0x9E3779B97F4A7C15)
        segment = spread >> np.uint64(64 - (self.bits - self.part)) if self.bits > self.part else np.zeros_like(hashes)
        return np.stack([(segment << np.uint64(self.part)) | ((first + np.uint64(i) * step) & low) for i in range(3)])

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.data, (places >> np.uint64(3)).ravel(), (np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)).ravel())

    def has(self, places: np.ndarray) -> np.ndarray:
        return ((self.data[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def entered(hashes: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task's two filters, in which these hashes have been entered."""
    once, twice = Filter(bits), Filter(bits)
    for some in hashes:
        seen, n = np.unique(some, return_counts=True)
        at = once.places(seen)
        twice.add(at[:, (n > 1) | once.has(at)])
        once.add(at)
    size = 1 << once.part >> 3
    for s in range(len(once.data) // size):
        a, b = once.data[s * size : (s + 1) * size], twice.data[s * size : (s + 1) * size]
        if a.any():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(a.tobytes(), 1)]), pa.array([zlib.compress(b.tobytes(), 1)])], schema=_SEGMENT)


def _merge_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    unpack = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
    for batch in batches:
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = unpack(a), unpack(b)
            if s in merged:
                once, twice = merged[s]
                merged[s] = once | a, twice | b | (once & a)
            else:
                merged[s] = a, b
    for s, (once, twice) in merged.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)]), pa.array([zlib.compress(twice.tobytes(), 1)])], schema=_SEGMENT)


def seen_twice(segments: DataFrame, bits: int) -> Broadcast:
    """The merged ``twice`` of all tasks' segments, 2^bits bits at most, sent to all tasks: first ``FAN_IN`` tasks' at a time, then all."""
    spark = segments.sparkSession
    width = min(shuffle_width(spark), 1 << (bits - segment_bits(bits)))
    merged = segments.withColumn("group", F.floor(F.spark_partition_id() / FAN_IN)).repartition(width, "segment", "group").drop("group").mapInArrow(trimmed(_merge_segments), SEGMENT_SQL)
    merged = merged.repartition(width, "segment").mapInArrow(trimmed(_merge_segments), SEGMENT_SQL).select("segment", "twice")
    with small_batches(spark):
        found = merged.collect()
    return spark.sparkContext.broadcast([(r.segment, bytes(r.twice)) for r in found])


def loaded(packed: list[tuple[int, bytes]], bits: int) -> Filter:
    """The filter that ``seen_twice`` has sent."""
    twice = Filter(bits)
    size = 1 << twice.part >> 3
    for s, some in packed:
        twice.data[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(some), np.uint8)
    return twice
