"""Counting 64-bit keys over a whole corpus without a row per key.

A task counts the keys of its documents and packs them, sorted, into one block
per range of the key space: deltas and counts, byte plane by byte plane, so that
the shuffle's own compression takes out the zero planes (about 6 bytes a key in
place of some 20). A range's blocks meet in one task and are added up.

There are as many shards as the input asks for, a power of two, but never more
than ``PARTITIONS`` ranges to shuffle to: with more shards than that a range's
task splits its blocks by shard, sorts them outside memory and adds up one shard
at a time. No task holds more than one shard's keys and one buffer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.words import U

FLUSH_KEYS = 3_000_000
SHARD_BYTES = 8 << 20
PARTITIONS = 4096
_UNKNOWN = 1 << 55


def shard_count(df: DataFrame) -> int:
    """A power of two: shards with the keys of some 8 MB of input files at most, and no fewer than shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << (max(1, min(least, PARTITIONS), -(-size // SHARD_BYTES) if size < _UNKNOWN else 0) - 1).bit_length()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The leading bits: equal ranges of the key space, in ascending order; ``shards`` is a power of two."""
    bits = shards.bit_length() - 1
    return (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts as byte planes."""
    delta = np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    n = np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(np.hstack([delta, n]).T).tobytes()


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(block, np.uint8).reshape(12, -1)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=U)
    return keys, np.ascontiguousarray(planes[8:].T).view("<u4").ravel()


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    counts = counts[order]
    del order
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.minimum(np.add.reduceat(counts, at, dtype=np.int64), 0xFFFFFFFF).astype(np.uint32) if len(at) else counts


def trim() -> None:
    """Gives freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of equal values."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return at, np.r_[at[1:], len(values)]


def _split(keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Sorted keys as one row (range, block) for each range that has any."""
    to = shard_of(keys, ranges)
    at, ends = _runs(to)
    return pa.RecordBatch.from_arrays(
        [pa.array(to[at].astype(np.int32)), pa.array([packed(keys[a:b], counts[a:b]) for a, b in zip(at, ends)], pa.binary())], ["shard", "block"]
    )


def blocks(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], shards: int) -> DataFrame:
    """(shard, block): what ``keys_of`` yields for each batch, counted by task and packed, one block a range."""
    ranges = min(shards, PARTITIONS)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        at, ends = _runs(keys)
        return _split(keys[at], ends - at, ranges)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                if len(keys):
                    held.append(keys)
                    size += len(keys)
                if size >= FLUSH_KEYS:
                    yield flush(held)
                    size = 0
        if held:
            yield flush(held)
        trim()

    return df.mapInArrow(run, "shard int, block binary")


class _Sum:
    """Blocks added up; what repeats between them is added up on the way."""

    def __init__(self):
        self.keys, self.counts, self.size, self.least = [], [], 0, FLUSH_KEYS

    def take(self, block: bytes) -> None:
        k, n = unpacked(block)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size >= self.least:
            k, n = self.total()
            self.keys.append(k), self.counts.append(n)
            self.size, self.least = len(k), max(FLUSH_KEYS, 2 * len(k))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate(self.keys), np.concatenate(self.counts)
        self.__init__()
        return added(k, n)


def _finer(shards: int):
    """mapInArrow over a range's blocks: the same keys in blocks by shard."""

    def run(batches):
        held = _Sum()
        for b in batches:
            for block in b.column(1):
                held.take(block.as_py())
                if held.size >= FLUSH_KEYS:
                    yield _split(*held.total(), shards)
        if held.size:
            yield _split(*held.total(), shards)
        trim()

    return run


def merged(blocks_: DataFrame, shards: int, result: Callable[[int, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """One call of ``result(shard, keys, counts)`` for each shard that has keys; its dict is the row."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        now, held = None, _Sum()
        for b in batches:
            for s, block in zip(b.column(0).to_pylist(), b.column(1)):
                if s != now and held.size:
                    yield row(now, *held.total())
                now = s
                held.take(block.as_py())
        if held.size:
            yield row(now, *held.total())
        trim()

    def row(s: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        got = result(s, keys, counts)
        return pa.RecordBatch.from_pylist([{c: got[c] for c in names}], schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return placed(blocks_, shards, _finer(shards)).mapInArrow(run, schema)


def placed(blocks_: DataFrame, shards: int, finer: Callable) -> DataFrame:
    """Blocks (shard, block) by shard, a shard's blocks one after another; ``finer`` splits the blocks of ranges where there are more shards."""
    out = blocks_.repartitionById(min(shards, PARTITIONS), F.col("shard"))
    return out.mapInArrow(finer, "shard int, block binary").sortWithinPartitions("shard") if shards > PARTITIONS else out


def planes(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)


def from_planes(block: bytes, *kinds) -> list[np.ndarray]:
    size = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(block) // sum(size), [], 0
    for k, w in zip(kinds, size):
        out.append(np.ascontiguousarray(np.frombuffer(block, np.uint8, n * w, at).reshape(w, n).T).view(k).ravel())
        at += n * w
    return out
