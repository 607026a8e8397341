"""Repeated passages, found through difference-cover anchors.

A difference cover of period P holds, for every d, two members whose difference
is d modulo P. Windows of ``WINDOW`` words are hashed only where the word's
number modulo P is in the cover. Two copies of a passage of at least
``WINDOW + P - 1`` words, wherever they stand in their documents, share a cover
position: for some k below P, both windows that start k words into the passage
are hashed. So a passage that repeats has a repeated anchor in each copy.

Around every repeated anchor the match is then extended: all windows of the full
length that hold one are compared, and those that come again merge into maximal
passages. Every copy is held against the first one, so the work grows with the
text in repeated passages, and not with the pairs of their copies.

Places of windows travel in sorted blocks, as in ``counting``. A window that
very many documents share would be one task's work. Such windows are told from
the documents of one hash class in ``_SAMPLE``; their first places are found by
an aggregate that combines before the shuffle, and are broadcast, so that their
copies are resolved where they stand. Which windows take this way doesn't matter
to the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.llm.counting import PARTITIONS, blocks, from_planes, merged, placed, planes, shard_count, shard_of, trim
from kgloom.llm.words import U, buffers, char_positions, doc_groups, mix, word_spans
from kgloom.plans.durable import written

PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
MATCH_WORDS = 50
BROADCAST_KEYS = 8_000_000
HOT_PLACES = 1_000_000
HOT_KEYS = 1_000_000
_SAMPLE = 64
_BASE = U(0x9E3779B97F4A7C15)


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = U(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[U(1), np.full(n, _BASE)], dtype=U)
        down = np.cumprod(np.r_[U(1), np.full(n, inv)], dtype=U)
    return up, down


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of words i..i+size-1 for every i; empty for shorter texts."""
    if len(h) < size:
        return np.zeros(0, U)
    up, down = _base_powers(len(h))
    with np.errstate(over="ignore"):
        total = np.r_[U(0), np.cumsum(mix(h) * up[: len(h)], dtype=U)]
        return mix((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def _documents(doc: np.ndarray, n: int) -> np.ndarray:
    """The first word of each of n documents, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def _anchors(doc: np.ndarray, h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the windows at cover positions; positions count within the document."""
    w = windows(h, size)
    if not len(w):
        return np.zeros(0, np.int64), w
    inside = doc[: len(w)] == doc[size - 1 :]
    chosen = np.zeros(PERIOD, bool)
    chosen[list(COVER)] = True
    at = np.flatnonzero(inside & chosen[(np.arange(len(w)) - first[doc[: len(w)]]) % PERIOD])
    return at, w[at]


def _slices(batch: pa.RecordBatch, column: int):
    data, offsets = buffers(batch.column(column))
    for i, j in doc_groups(offsets):
        a, b = offsets[i], offsets[j]
        local = offsets[i : j + 1] - a
        doc, s, e, h = word_spans(data[a:b], local)
        yield i, j, data[a:b], local, doc, s, e, h


def repeated_anchors(docs: DataFrame, match_words: int) -> DataFrame:
    """(keys, n): the repeated anchor hashes of each shard, as 8 bytes each, and their number."""
    size, shards = match_words - PERIOD + 1, shard_count(docs)

    def keys_of(batch):
        for i, j, _, _, doc, _, _, h in _slices(batch, 1):
            yield _anchors(doc, h, _documents(doc, j - i), size)[1]

    def shard(_, keys, counts):
        twice = keys[counts > 1]
        return {"keys": twice.tobytes(), "n": len(twice)}

    return written(merged(blocks(docs, keys_of, shards), shards, shard, "keys binary, n long"), "anchors")


#: Columns of a block: key, document, word, first character, characters.
_KINDS = (U, np.int64, np.int32, np.int32, np.int32)
_BLOCKS = "shard int, block binary"
Places = list[np.ndarray]


def _extend(batch: pa.RecordBatch, match_words: int, hits) -> Places:
    """All full windows of a batch that hold a repeated anchor; ``hits(i, keys, words)`` tells which anchors are."""
    size = match_words - PERIOD + 1
    out = []
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for i, j, data, offsets, doc, s, e, h in _slices(batch, 1):
        first = _documents(doc, j - i)
        at, keys = _anchors(doc, h, first, size)
        at = at[hits(i, keys, at, doc, first)]
        if not len(at):
            continue
        # a window at w holds the anchors that start at w .. w + PERIOD - 1
        mark = np.zeros(len(h) + 1, np.int64)
        np.add.at(mark, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(mark, at + 1, -1)
        held = np.cumsum(mark)[: len(h)] > 0
        full = windows(h, match_words)
        w = np.flatnonzero(held[: len(full)] & (doc[: len(full)] == doc[match_words - 1 :]))
        if not len(w):
            continue
        place = char_positions(data)
        start, stop = place[s[w]], place[e[w + match_words - 1]]
        out.append((full[w], ids[i + doc[w]].astype(np.int64), (w - first[doc[w]]).astype(np.int32), (start - place[offsets[doc[w]]]).astype(np.int32), (stop - start).astype(np.int32)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, k) for k in _KINDS]


def _blocks(places: Places, shard: np.ndarray):
    """A batch of (shard, block) of rows that are sorted by shard, their first column as differences."""
    if len(shard):
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        body = [planes(np.diff(places[0][a:z], prepend=places[0].dtype.type(0)), *(c[a:z] for c in places[1:])) for a, z in zip(at, np.r_[at[1:], len(shard)])]
        yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(body, pa.binary())], ["shard", "block"])


def _rows(body: bytes) -> Places:
    key, *rest = from_planes(body, *_KINDS)
    return [np.cumsum(key, dtype=U), *rest]


def _by_key(places: Places, ranges: int):
    order = np.argsort(places[0], kind="stable")
    places = [c[order] for c in places]
    yield from _blocks(places, shard_of(places[0], ranges))


def _by_document(later: Places, ranges: int):
    """``later``: (document as the key, source, word, first character, characters)."""
    shard = shard_of(mix(later[0]), ranges)
    order = np.lexsort((later[2], later[1], later[0], shard))
    yield from _blocks([c[order] for c in later], shard[order])


def _finer(shards: int, split):
    def run(batches):
        for b in batches:
            for body in b.column(1):
                yield from split(_rows(body.as_py()), shards)

    return run


def _of_each_shard(result):
    """mapInArrow over blocks that lie by shard: ``result(rows)`` of each shard."""

    def run(batches):
        now, held = None, []
        for b in batches:
            for s, body in zip(b.column(0).to_pylist(), b.column(1)):
                if s != now and held:
                    yield from result([np.concatenate(c) for c in zip(*held)])
                    held = []
                now = s
                held.append(_rows(body.as_py()))
        if held:
            yield from result([np.concatenate(c) for c in zip(*held)])
        del held
        trim()

    return run


def _passages(later: Places, match_words: int):
    """Consecutive windows with one source document form a passage."""
    doc, source, word, start, size = later
    order = np.lexsort((start, word, source, doc))
    doc, source, word, start, stop = doc[order], source[order], word[order], start[order], (start + size)[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (word[1:] - word[:-1] > 1)])
    last = np.r_[at[1:], len(doc)] - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[at].view(np.int64)), pa.array(np.minimum.reduceat(start, at)), pa.array(np.maximum.reduceat(stop, at)), pa.array(word[last] - word[at] + np.int32(match_words)), pa.array(source[at])],
        ["doc_id", "start", "stop", "n_words", "dup_of"],
    )


def repeated_passages(docs: DataFrame, match_words: int = MATCH_WORDS, broadcast_keys: int = BROADCAST_KEYS, text: str = "text", doc_id: str = "doc_id", hot_places: int = HOT_PLACES) -> DataFrame:
    """(doc_id, start, stop, n_words, dup_of) of every passage that stands elsewhere before.

    A row is a maximal run of ``match_words``-word windows each of which occurs
    before, in the sense of (doc_id, position), with its first occurrence in
    document ``dup_of`` (which may be the document itself). ``start`` and
    ``stop`` count characters of the text from 0, ``stop`` exclusive. Words
    are compared without regard to case, punctuation or spacing. All passages
    of at least ``match_words`` words are found.

    Null, empty and shorter texts have none; rows without id take no part.
    Rows that share an id are one document, in which a place counts once.
    Other columns are ignored; an empty table gives no rows.

    Up to ``broadcast_keys`` repeated anchors (8 bytes each) are sent to the
    scan; beyond, they are joined by a shuffle, to the same result. Windows with
    more than about ``hot_places`` places are spread over tasks. Windows are equal
    when the 64-bit hashes of their words are.
    """
    if match_words < PERIOD:
        raise ValueError(f"match_words must be at least {PERIOD}")
    src = docs.select(names.col(docs, doc_id).cast("long").alias("doc_id"), names.col(docs, text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    again = repeated_anchors(src, match_words)
    if (again.agg(F.sum("n")).first()[0] or 0) <= broadcast_keys:
        got = [np.frombuffer(k.as_py(), U) for k in again.select("keys").toArrow().column(0)]
        held = docs.sparkSession.sparkContext.broadcast(np.sort(np.concatenate(got)) if got else np.zeros(0, U))

        def known(i, keys, at, doc, first):
            at = np.searchsorted(held.value, keys)
            at[at == len(held.value)] = 0
            return held.value[at] == keys if len(held.value) else np.zeros(len(keys), bool)

        def rows_of(docs_: DataFrame):
            return docs_, lambda b: known

    else:

        def rows_of(docs_: DataFrame):
            return _marked(docs_, again, match_words), _marks

    def each(docs_: DataFrame, emit, schema: str) -> DataFrame:
        """``emit(places)`` of every batch of documents."""
        rows, hits = rows_of(docs_)

        def run(batches):
            for b in batches:
                yield from emit(_extend(b, match_words, hits(b)))
            trim()

        return rows.mapInArrow(run, schema)

    shards = shard_count(src)
    ranges = min(shards, PARTITIONS)
    hot = _hot(each(src.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SAMPLE)) == 0), _keys, "key long"), hot_places)
    if hot is None:
        places, resolved = each(src, lambda p: _by_key(p, ranges), _BLOCKS), None
    else:
        first = _firsts(each(src, lambda p: _least(p, hot.value), "key long, doc_id long, word int"))
        places = each(src, lambda p: _by_key([c[~_in(p[0], first.value[0])[0]] for c in p], ranges), _BLOCKS)
        resolved = each(src, lambda p: _by_document(_later_than(p, first.value), ranges), _BLOCKS)

    # all occurrences of a window meet; every later one points to the first
    def later(p: Places):
        order = np.lexsort((p[3], p[2], p[1], p[0]))
        key, doc, word, start, size = (c[order] for c in p)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        head = np.repeat(at, np.diff(np.r_[at, len(key)]))
        # of rows that share an id and a place the first alone counts, so it goes by the place
        rest = np.flatnonzero((doc != doc[head]) | (word != word[head]))
        yield from _by_document([doc[rest].view(U), doc[head[rest]], word[rest], start[rest], size[rest]], ranges)

    found = placed(places, shards, _finer(shards, _by_key)).mapInArrow(_of_each_shard(later), _BLOCKS)
    if resolved is not None:
        found = found.unionByName(resolved)
    return placed(found, shards, _finer(shards, _by_document)).mapInArrow(_of_each_shard(lambda p: _passages(p, match_words)), "doc_id long, start int, stop int, n_words int, dup_of long")


def _keys(p: Places):
    yield pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64))], ["key"])


def _in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is known, its place among the sorted known ones)."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys, at


def _hot(some: DataFrame, hot_places: int):
    """The broadcast keys of the windows that are likely to have more than ``hot_places`` places; None if there are none.

    Up to ``HOT_KEYS`` of them; others go the way of all windows.
    """
    hot = some.groupBy("key").count().where(F.col("count") > max(1, hot_places // _SAMPLE)).orderBy(F.desc("count")).limit(HOT_KEYS).select("key")
    keys = np.sort(hot.toArrow().column(0).to_numpy().view(U))
    return some.sparkSession.sparkContext.broadcast(keys) if len(keys) else None


def _least(p: Places, keys: np.ndarray):
    """The first place of each of the keys in a batch."""
    mine = _in(p[0], keys)[0]
    key, doc, word = (c[mine] for c in p[:3])
    order = np.lexsort((word, doc, key))
    at = order[np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])] if len(key) else order
    yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(doc[at]), pa.array(word[at])], ["key", "doc_id", "word"])


def _firsts(places: DataFrame):
    """The broadcast (keys, documents, words) of the first places, by key."""
    got = places.groupBy("key").agg(F.min(F.struct("doc_id", "word")).alias("f")).select("key", "f.doc_id", "f.word").toArrow()
    key = got.column(0).to_numpy().view(U)
    order = np.argsort(key)
    return places.sparkSession.sparkContext.broadcast((key[order], got.column(1).to_numpy()[order], got.column(2).to_numpy()[order]))


def _later_than(p: Places, first: tuple) -> Places:
    mine, at = _in(p[0], first[0])
    doc, word = (x[at] if len(x) else np.zeros(len(at), x.dtype) for x in first[1:])
    rest = np.flatnonzero(mine & ((p[1] != doc) | (p[2] != word)))
    return [p[1][rest].view(U), doc[rest], p[2][rest], p[3][rest], p[4][rest]]


def _marked(src: DataFrame, again: DataFrame, match_words: int) -> DataFrame:
    """(doc_id, text, words): documents with their repeated anchors, found by joining anchors and keys by a shuffle."""
    size = match_words - PERIOD + 1
    rows = written(src.withColumn("row", F.expr("uuid()")), "anchor-docs")

    def anchors(batches):
        for b in batches:
            for i, j, _, _, doc, _, _, h in _slices(b, 1):
                first = _documents(doc, j - i)
                at, keys = _anchors(doc, h, first, size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(2).take(pa.array(i + doc[at])), pa.array((at - first[doc[at]]).astype(np.int32))], ["key", "row", "word"])

    def keys(batches):
        for b in batches:
            for k in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64))], ["key"])

    marked = rows.select("doc_id", "text", "row").mapInArrow(anchors, "key long, row string, word int").join(again.select("keys").mapInArrow(keys, "key long"), "key", "left_semi")
    marked = marked.groupBy("row").agg(F.sort_array(F.collect_list("word")).alias("words"))

    return rows.join(marked, "row").select("doc_id", "text", "words")


def _marks(batch: pa.RecordBatch):
    """Which anchors of a batch of ``_marked`` repeat."""
    words = batch.column(2)

    def known(i, keys, at, doc, first):
        mine = words.slice(i, len(first) - 1)
        size = mine.value_lengths().to_numpy()
        return np.isin(at, np.repeat(first[:-1], size) + mine.flatten().to_numpy())

    return known
