"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The counts of all n-grams of the corpus are quantised to levels of a logarithmic
scale, two levels to an octave: counts 1, 2 and 3 have levels of their own, then
4-5, 6-7, 8-11, 12-15 and so on. A filter holds the pairs (n-gram, 2), ...,
(n-gram, level). A reader probes for level 2, 3, ... until a pair is missing;
the last one found gives the count back. Level 1 needs no pair: every n-gram
that is looked up comes from a document of the corpus, so its count is 1 at
least. Nothing is pruned; an n-gram that occurs once is one that has no pair.

A false hit can only raise a count. An n-gram is only probed if both n-grams
one word shorter in it have been found at level 2, and its level is at most
theirs, as no n-gram occurs more often than its parts.

A document is no evidence for itself: its own occurrences are taken off the
counts before they are used, so an n-gram of one document alone counts as
unseen there. Probabilities interpolate relative frequencies of all orders down
to an add-one unigram; where a context is unseen the shorter one's probability
stands alone.

The filter is laid out in cells of the key space, each as large as its own pairs
ask for, whatever the number of tasks that build it. Up to ``broadcast_mb`` it is
broadcast and documents never move; beyond, the distinct n-grams of each chunk
of documents go to the filter and levels come back, to the same scores.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.llm.counting import PARTITIONS, blocks, merged, packed, shard_count, shard_of, trim, unpacked
from kgloom.llm.words import U, buffers, doc_groups, mix, word_spans
from kgloom.plans.durable import written

ORDER = 3
BITS_PER_PAIR = 24
WEIGHT = 0.6
BROADCAST_MB = 256
PIECE_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
CELLS = 1 << 16
_JOIN = U(0x9E3779B97F4A7C15)
_LEVEL = U(0xA24BAED4963EE407)
#: The least count of each level from 1 on, to beyond 2^32.
LOW = np.array([1, 2, 3, *[(2 + half) << k for k in range(1, 32) for half in (0, 1)]], np.int64)
#: The middle of each level's counts; 0 for level 0.
MIDDLE = np.r_[0.0, (LOW[:-1] + LOW[1:] - 1) / 2]


def ngrams(doc: np.ndarray, h: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the 1..order-grams that start at each word; shorter lists where a document ends.

    The n-th list has, at i, the n-gram of words i..i+n-1, for i up to len - n;
    those that span two documents have to be left out with ``whole``. The lowest
    bit tells single words from longer n-grams.
    """
    out = [mix(h ^ U(1)) | U(1)]
    with np.errstate(over="ignore"):
        joined = h
        for n in range(2, order + 1):
            joined = mix(joined[: len(h) - n + 1] * _JOIN + h[n - 1 :]) if len(h) >= n else np.zeros(0, U)
            out.append(mix(joined ^ U(n)) & ~U(1))
    return out


def whole(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether words i..i+n-1 are of one document."""
    return doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOW, counts, "right")


def others_of(levels: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How often n-grams of these levels occur elsewhere, of which ``own`` are in the document itself.

    Exact up to counts of 3; beyond, the middle of the level stands for the
    count, and what reaches the level's least count by itself is all there is.
    """
    return np.where(own < LOW[np.maximum(levels, 1) - 1], np.maximum(MIDDLE[levels] - own, 0.0), 0.0)


def _place(keys: np.ndarray, level: int, half: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits in it) of each pair, once for either half: five bits of one 64-bit word each."""
    with np.errstate(over="ignore"):
        h = mix(keys + _LEVEL * U(level))
        if half:
            h = mix(h ^ _JOIN)
        bits = np.zeros(len(keys), U)
        for k in range(5):
            bits |= U(1) << ((h >> U(6 * k)) & U(63))
        return (((h >> U(32)) * size) >> U(32)).astype(np.int64), bits


def fill(keys: np.ndarray, levels: np.ndarray, cells: int, bits_per_pair: int = BITS_PER_PAIR) -> tuple[np.ndarray, np.ndarray]:
    """(words of each of the last to the first key's cells, the words) of sorted keys; cells are equal ranges of all keys."""
    cell = shard_of(keys, cells)
    first = int(cell[0]) if len(cell) else 0
    pairs = np.bincount(cell - first, np.maximum(levels - 1, 0)) if len(cell) else np.zeros(0)
    size = -(-pairs.astype(np.int64) * bits_per_pair // 64)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), U)
    at, q = np.flatnonzero(levels >= 2), 2
    while len(at):
        own = cell[at] - first
        for half in range(2):
            word, bits = _place(keys[at], q, half, size[own].astype(U))
            np.bitwise_or.at(out, start[own] + word, bits)
        q += 1
        at = at[levels[at] >= q]
    return size.astype(np.int32), out


class LogFrequencyFilter:
    """The cells of a filter, side by side in one array."""

    def __init__(self, cells: int, parts: Iterable[tuple[int, np.ndarray, np.ndarray]], total: int):
        """``parts``: (first cell, words of each cell from there, words), of ``total`` words together; taken in one by one."""
        self.cells = cells
        self.size, self.start = np.zeros(cells, U), np.zeros(cells, np.int64)
        self.words = np.empty(total, U)
        at = 0
        for first, size, words in parts:
            self.size[first : first + len(size)] = size
            self.start[first : first + len(size)] = at + np.cumsum(size, dtype=np.int64) - size
            self.words[at : at + len(words)] = words
            at += len(words)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probing from 2 on until a pair is missing."""
        out = np.ones(len(keys), np.int8)
        cell = shard_of(keys, self.cells)
        at, level = np.flatnonzero(self.size[cell] > 0), 2
        while len(at):
            for half in range(2):
                c = cell[at]
                word, bits = _place(keys[at], level, half, self.size[c])
                at = at[(self.words[word + self.start[c]] & bits) == bits]
            out[at] = level
            level += 1
        return out


class Pieces:
    """A filter broadcast in pieces, so that the driver never holds it whole; a task puts it together and drops it."""

    def __init__(self, table: DataFrame, cells: int, sizes: list[tuple[int, int]]):
        """``sizes``: (shard, bytes)."""
        self.cells, self.total, self.held = cells, sum(n for _, n in sizes) // 8, []
        group, size = [], 0
        for s, n in [*sorted(sizes), (-1, PIECE_BYTES)]:
            if group and size + n > PIECE_BYTES:
                got = table.where(F.col("shard").between(group[0], group[-1])).select("cell", "sizes", "filter").toArrow()
                piece = [tuple(r.values()) for r in got.to_pylist()]
                self.held.append(table.sparkSession.sparkContext.broadcast(piece))
                del got, piece
                group, size = [], 0
            group.append(s)
            size += n

    def filter(self) -> LogFrequencyFilter:
        return LogFrequencyFilter(self.cells, self._parts(), self.total)

    def _parts(self):
        for b in self.held:
            yield from _parts(b.value)
            if hasattr(b, "_value"):
                del b._value


def _parts(rows):
    for first, sizes, words in rows:
        yield first, np.frombuffer(sizes, np.int32), np.frombuffer(words, U)


def _keys(texts: pa.Array, order: int):
    """(first text, end, document of each word, keys of each order) for slices of an array of texts."""
    data, offsets = buffers(texts)
    for i, j in doc_groups(offsets):
        a, b = offsets[i], offsets[j]
        doc, _, _, h = word_spans(data[a:b], offsets[i : j + 1] - a)
        yield i, j, doc, ngrams(doc, h, order)


def _model(docs: DataFrame, order: int) -> tuple[DataFrame, int, int]:
    """(the filter's shards as a table in the shared folder, their number, the number of cells)."""
    shards = shard_count(docs)
    cells = max(CELLS, shards)

    def keys_of(batch: pa.RecordBatch):
        for _, _, doc, keys in _keys(batch.column(1), order):
            for n, k in enumerate(keys, 1):
                yield k[whole(doc, n)]

    def shard(s: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        single = (keys & U(1)) == 1
        sizes, words = fill(keys, level_of(counts), cells)
        return {
            "shard": s, "words": int(single.sum()), "tokens": int(counts[single].sum(dtype=np.int64)), "cell": int(shard_of(keys[:1], cells)[0]), "sizes": sizes.tobytes(), "filter": words.tobytes(),
        }

    table = merged(blocks(docs, keys_of, shards), shards, shard, "shard int, words long, tokens long, cell long, sizes binary, filter binary")
    return written(table, "lm-filter"), shards, cells


def _sought(doc: np.ndarray, keys: list[np.ndarray], lookup) -> list[np.ndarray]:
    """Levels of all n-grams by ``lookup(keys)``; one with a part that occurs once isn't looked up, and has level 1."""
    single, back = np.unique(keys[0], return_inverse=True)
    out = [lookup(single)[back]]
    for n, k in enumerate(keys[1:], 2):
        level, below = np.ones(len(k), np.int8), out[-1]
        ask = np.flatnonzero(whole(doc, n) & (below[: len(k)] > 1) & (below[1 : len(k) + 1] > 1))
        level[ask] = np.minimum(lookup(k[ask]), np.minimum(below[ask], below[ask + 1]))
        out.append(level)
    return out


def _elsewhere(doc: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in other documents."""
    own = np.ones(len(keys), np.int64)
    at = np.flatnonzero(levels > 1)
    if len(at):
        with np.errstate(over="ignore"):
            mine = mix(keys[at] + doc[at].astype(U) * _LEVEL)
        _, back, n = np.unique(mine, return_inverse=True, return_counts=True)
        own[at] = n[back]
    return others_of(levels, own)


def _scores(ids: pa.Array, doc: np.ndarray, keys: list[np.ndarray], lookup, tokens: int, words: int, weight: float) -> pa.RecordBatch:
    n = np.bincount(doc, minlength=len(ids))
    c = [_elsewhere(doc, k, level) for k, level in zip(keys, _sought(doc, keys, lookup))]
    p = (c[0] + 1) / (tokens - n[doc] + words + 1)
    for k in range(2, len(c) + 1):
        # the k-gram that ends at word i starts at i - k + 1
        full, context = c[k - 1], c[k - 2][: len(c[k - 1])]
        seen = whole(doc, k) & (context > 0)
        end = np.flatnonzero(seen) + k - 1
        p[end] = weight * np.minimum(1.0, full[seen] / context[seen]) + (1 - weight) * p[end]
    some = n > 0
    each = np.divide(np.bincount(doc, np.log10(p), len(ids)), n, out=np.zeros(len(n)), where=some)
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(each, mask=~some), pa.array(10.0**-each, mask=~some)], ["doc_id", "n_words", "log10_prob_per_word", "perplexity"])


_SCHEMA = "doc_id long, n_words long, log10_prob_per_word double, perplexity double"


def score(docs: DataFrame, order: int = ORDER, weight: float = WEIGHT, broadcast_mb: float = BROADCAST_MB, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, log10_prob_per_word, perplexity) of every row under the n-grams of all other rows.

    All documents are counted and all are scored, each without its own
    occurrences. The result doesn't depend on the session's settings or on how
    the rows are partitioned. A null, empty or wordless text has 0 words and
    null scores. Null ids stay null; repeated rows are documents of their own,
    that count and are scored each. Texts of any length are read whole. Other
    columns are ignored; an empty table gives no rows.
    """
    if order < 1:
        raise ValueError("order must be positive")
    src = docs.select(names.col(docs, doc_id).cast("long").alias("doc_id"), names.col(docs, text).cast("string").alias("text"))
    table, shards, cells = _model(src, order)
    size, tokens, words = table.agg(F.sum(F.length("filter")), F.sum("tokens"), F.sum("words")).first()
    tokens, words = int(tokens or 0), int(words or 0)
    if (size or 0) > broadcast_mb * 1e6:
        return _score_by_shuffle(src, table, shards, cells, order, tokens, words, weight)
    pieces = Pieces(table, cells, [tuple(r) for r in table.select("shard", F.length("filter")).collect()])

    def run(batches):
        known = None
        for b in batches:
            known = known or pieces.filter()
            for i, j, doc, keys in _keys(b.column(1), order):
                yield _scores(b.column(0).slice(i, j - i), doc, keys, known.levels, tokens, words, weight)
        del known
        trim()

    return src.mapInArrow(run, _SCHEMA)


def _chunked(batches):
    """Rows with a chunk number; a chunk has about ``CHUNK_BYTES`` of text."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for b in batches:
        _, offsets = buffers(b.column(1))
        for i, j in doc_groups(offsets, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.full(j - i, number))], ["doc_id", "text", "chunk"])
            number += 1


def _score_by_shuffle(src: DataFrame, table: DataFrame, shards: int, cells: int, order: int, tokens: int, words: int, weight: float) -> DataFrame:
    """The same with each chunk's distinct n-grams sent to the filter and the levels above 1 sent back."""
    rows = written(src.mapInArrow(_chunked, "doc_id long, text string, chunk long"), "lm-docs")
    ranges = min(shards, PARTITIONS)

    def asked(batches):
        for b in batches:
            chunk = b.column(2).to_numpy()
            edge = [*np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]).tolist(), len(chunk)] if len(chunk) else [0]
            for a, z in zip(edge, edge[1:]):
                keys = [k[whole(doc, n)] for _, _, doc, by in _keys(b.column(1).slice(a, z - a), order) for n, k in enumerate(by, 1)]
                keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, U)
                to = shard_of(keys, ranges)
                at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
                body = [packed(k, np.ones(len(k), np.int64)) for k in np.split(keys, at[1:])] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), pa.array(np.full(len(at), chunk[a])), pa.array(body, pa.binary())], ["range", "chunk", "body"])

    asks = rows.select("doc_id", "text", "chunk").mapInArrow(asked, "range int, chunk long, body binary")
    none = F.lit(None)
    held = table.select((F.col("shard") / (shards // ranges)).cast("int").alias("range"), none.cast("long").alias("chunk"), F.col("filter").alias("body"), "cell", "sizes")
    both = asks.select("*", none.cast("long").alias("cell"), none.cast("binary").alias("sizes")).unionByName(held)

    def answered(batches):
        parts, known = [], None
        for b in batches:
            out = []
            for chunk, body, cell, sizes in zip(*(b.column(c).to_pylist() for c in ("chunk", "body", "cell", "sizes"))):
                if chunk is None:  # the filter's rows sort first
                    parts.append((cell, sizes, body))
                    continue
                if known is None:
                    known = LogFrequencyFilter(cells, _parts(parts), sum(len(p[2]) for p in parts) // 8)
                    parts.clear()
                keys, _ = unpacked(body)
                level = known.levels(keys)
                if (level > 1).any():
                    out.append((chunk, packed(keys[level > 1], level[level > 1].astype(np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["chunk", "body"])
        trim()

    answers = both.repartitionById(ranges, F.col("range")).sortWithinPartitions(F.col("chunk").asc_nulls_first()).mapInArrow(answered, "chunk long, body binary")

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [unpacked(x.as_py()) for x in right.column("body")]
        keys, level = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, U), np.zeros(0, np.uint32))
        keys, first = np.unique(keys, return_index=True)  # a chunk may have been read by two tasks
        level = level[first].astype(np.int8)

        def lookup(k: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, k)
            at[at == len(keys)] = 0
            return np.where(keys[at] == k, level[at], np.int8(1)) if len(keys) else np.ones(len(k), np.int8)

        texts, ids = left.column("text").combine_chunks(), left.column("doc_id").combine_chunks()
        return pa.Table.from_batches([_scores(ids.slice(i, j - i), doc, k, lookup, tokens, words, weight) for i, j, doc, k in _keys(texts, order)])

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(final, _SCHEMA)
