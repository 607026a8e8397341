"""Exact deduplication through a cuckoo-filter index of text digests.

Digests alone are shuffled at first. Each task runs those of its rows through a
cuckoo filter: one that misses is inserted, one that hits has come before. So a
digest leaves the task once, however many copies it stands for, with the word
whether it hit. A second filter over each range of digests takes these in; what
hits there, or has hit before, is repeated, and the digests that came once are
deleted from it again. The filters grow from their stored keys.

The repeated digests go to the scan as one filter, where texts that miss are
known to be unique and never move; texts that hit are bucketed by digest and
verified against each other's content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.llm.counting import trim
from kgloom.llm.words import U, mix
from kgloom.plans.durable import cut

SLOTS = 4
BROADCAST_MB = 64


class CuckooFilter:
    """Buckets of four 16-bit fingerprints beside the stored 64-bit keys.

    ``insert``, ``delete`` and ``contains`` take arrays. A key sits in one of two
    buckets, each found from the other and the fingerprint. When a key finds no
    place within ``kicks`` moves, or the load passes 95 %, the table doubles and
    is refilled from the stored keys. Keys are kept once each.
    """

    def __init__(self, expected: int = 64, kicks: int = 200):
        self.kicks, self.size = kicks, 0
        self._clear(1 << max(2, int(np.ceil(np.log2(max(1, expected) / SLOTS / 0.9)))))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.keys = np.zeros((buckets, SLOTS), U)

    def _places(self, keys: np.ndarray):
        with np.errstate(over="ignore"):
            h = mix(keys)
            fp = (h >> U(48)).astype(np.uint16)
            fp[fp == 0] = 1
            a = (h & U(self.mask)).astype(np.int64)
            b = self._other(a, fp)
        return fp, a, b

    def _other(self, bucket, fp):
        with np.errstate(over="ignore"):
            return (bucket ^ mix(np.asarray(fp).astype(U)).astype(np.int64)) & self.mask

    def contains(self, keys: np.ndarray, verify: bool = True) -> np.ndarray:
        """Whether each key is there; without ``verify`` only fingerprints are compared."""
        keys = np.asarray(keys, U)
        fp, a, b = self._places(keys)
        out = np.zeros(len(keys), bool)
        for at in (a, b):
            same = self.prints[at] == fp[:, None]
            if verify:
                same &= self.keys[at] == keys[:, None]
            out |= same.any(1)
        return out

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds the keys; returns which of them were new (the first of equal ones)."""
        keys = np.asarray(keys, U)
        new = np.zeros(len(keys), bool)
        _, first = np.unique(keys, return_index=True)
        new[first] = ~self.contains(keys[first])
        todo = keys[new]
        need = self.size + len(todo)
        if need > 0.95 * self.prints.size:
            self._resize(need)
        self._place(todo)
        self.size = need
        return new

    def _resize(self, need: int) -> None:
        stored = self.keys[self.prints > 0]
        buckets = (self.mask + 1) * 2
        while need > 0.9 * buckets * SLOTS:
            buckets *= 2
        self._clear(buckets)
        self._place(stored)

    def _place(self, keys: np.ndarray) -> None:
        for side in range(2):
            if not len(keys):
                return
            fp, *at = self._places(keys)
            at = at[side]
            order = np.argsort(at, kind="stable")
            keys, fp, at = keys[order], fp[order], at[order]
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))
            free = np.argsort(self.prints[at] > 0, axis=1, kind="stable")
            fits = rank < (self.prints[at] == 0).sum(1)
            slot = free[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.prints[at[fits], slot[fits]] = fp[fits]
            self.keys[at[fits], slot[fits]] = keys[fits]
            keys = keys[~fits]
        for i in range(len(keys)):
            if not self._kick(keys[i]):
                stored = np.r_[self.keys[self.prints > 0], keys[i:]]
                self._clear((self.mask + 1) * 2)
                self._place(stored)
                return

    def _kick(self, key) -> bool:
        """Places one key by moving others; puts all back when it can't."""
        fp, a, b = self._places(np.array([key], U))
        fp, at = fp[0], int(b[0])
        trail = []
        for turn in range(self.kicks):
            free = np.flatnonzero(self.prints[at] == 0)
            if len(free):
                self.prints[at, free[0]], self.keys[at, free[0]] = fp, key
                return True
            slot = turn % SLOTS
            trail.append((at, slot, self.prints[at, slot], self.keys[at, slot]))
            (fp, key), (self.prints[at, slot], self.keys[at, slot]) = (self.prints[at, slot], self.keys[at, slot]), (fp, key)
            at = int(self._other(at, fp))
        for at, slot, fp, key in reversed(trail):
            self.prints[at, slot], self.keys[at, slot] = fp, key
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Removes the keys; returns which were there."""
        keys = np.asarray(keys, U)
        gone = np.zeros(len(keys), bool)
        _, first = np.unique(keys, return_index=True)
        fp, a, b = self._places(keys[first])
        for at in (a, b):
            same = (self.prints[at] == fp[:, None]) & (self.keys[at] == keys[first][:, None])
            row, slot = np.nonzero(same)
            self.prints[at[row], slot] = 0
            gone[first[row]] = True
        self.size -= int(gone.sum())
        return gone

    def live(self) -> np.ndarray:
        return self.keys[self.prints > 0]


class ExactIndex:
    """A live index of texts: digests in a cuckoo filter, content in buckets.

    ``add`` returns the key under which an equal text is already held, or None
    after taking the text in; ``remove`` forgets a text. For increments of a
    shard; over a whole corpus ``repeated_digests`` does the same in bulk.
    """

    def __init__(self, digest):
        self.digest, self.filter, self.content = digest, CuckooFilter(), {}

    def add(self, key, text):
        d = np.array([self.digest(text)], U)
        if self.filter.contains(d, verify=False)[0]:
            for k, t in self.content.get(int(d[0]), []):
                if t == text:
                    return k
        self.filter.insert(d)
        self.content.setdefault(int(d[0]), []).append((key, text))
        return None

    def remove(self, text) -> bool:
        d = int(self.digest(text))
        held = self.content.get(d, [])
        rest = [(k, t) for k, t in held if t != text]
        if len(rest) == len(held):
            return False
        if rest:
            self.content[d] = rest
        else:
            del self.content[d]
            self.filter.delete(np.array([d], U))
        return True


def _seen(batches):
    """One task's digests, each once, and whether it came more than once."""
    index, again = CuckooFilter(1 << 12), [np.zeros(0, U)]
    for b in batches:
        d = b.column(0).to_numpy().view(U)
        again.append(np.unique(d[~index.insert(d)]))
    live = index.live()
    yield pa.RecordBatch.from_arrays([pa.array(live.view(np.int64)), pa.array(np.isin(live, np.concatenate(again)))], ["digest", "again"])
    del index, live, again
    trim()


def _repeats(batches):
    """One range's digests through a filter that ends up with the repeated ones."""
    index, again = CuckooFilter(1 << 12), [np.zeros(0, U)]
    for b in batches:
        d = b.column(0).to_numpy().view(U)
        hit = ~index.insert(d) | b.column(1).to_numpy(zero_copy_only=False)
        again.append(np.unique(d[hit]))
    live = index.live()
    index.delete(live[~np.isin(live, np.concatenate(again))])
    yield pa.RecordBatch.from_arrays([pa.array(index.live().view(np.int64))], ["digest"])
    del index, live, again
    trim()


def repeated_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest): the 64-bit digests that occur in more than one row."""
    rows = docs.select(F.xxhash64(names.col(docs, text)).alias("digest"))
    return rows.mapInArrow(_seen, "digest long, again boolean").repartition("digest").mapInArrow(_repeats, "digest long")


def _split(docs: DataFrame, text: str, broadcast_mb: float) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely unique, rows to verify); rows are (d, t, _row), with the text in t alone."""
    t = names.col(docs, text)
    rows = docs.select(F.xxhash64(t).alias("d"), t.alias("t"), F.struct(*[docs[f"`{c}`"] for c in docs.columns if c.lower() != text.lower()]).alias("_row"))
    repeated = cut(repeated_digests(docs, text))
    n = repeated.count()
    if n * 12 / 1e6 > broadcast_mb:  # 10 bytes a slot at a load of about 0.85
        repeated = repeated.withColumnRenamed("digest", "d")
        return rows.join(repeated, "d", "left_anti"), rows.join(repeated, "d", "left_semi")
    index = CuckooFilter(n)
    index.insert(repeated.toArrow().column(0).to_numpy().view(U))
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def hit(d: pa.Array) -> pa.Array:
        return pa.array(held.value.contains(d.to_numpy(zero_copy_only=False).view(U)))

    return rows.where(~hit("d")), rows.where(hit("d"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """(doc_id, dup_of): each document whose text equals that of a smaller id.

    Texts are equal when all their bytes are; null equals null only, empty
    equals empty. Rows of one id and text are one document. Null ids come in no
    pair. Other columns are ignored; an empty table gives no rows.

    Up to ``broadcast_mb`` of filter it is sent to the scan; beyond, the
    repeated digests are joined by a shuffle, to the same result.
    """
    ids = docs.select(names.col(docs, doc_id).cast("long").alias("doc_id"), names.col(docs, text).alias("text")).where("doc_id is not null")
    _, suspects = _split(ids, "text", broadcast_mb)
    suspects = suspects.select("d", "t", F.col("_row.doc_id").alias("doc_id"))
    # a bucket whose smallest and largest content are equal holds one text
    null = F.count_if(F.col("t").isNull())
    bucket = suspects.groupBy("d").agg(F.min("doc_id").alias("dup_of"), F.coalesce((F.min("t") == F.max("t")) & (null == 0), null == F.count("*")).alias("one"))
    bucket = cut(bucket)
    pairs = suspects.select("d", "doc_id").distinct().join(bucket.where("one"), "d").select("doc_id", "dup_of")
    mixed = bucket.where("not one").select("d")
    if mixed.take(1):
        several = suspects.join(mixed, "d", "left_semi")
        first = several.groupBy("d", "t").agg(F.min("doc_id").alias("dup_of"))
        same = several.alias("a").join(first.alias("b"), (F.col("a.d") == F.col("b.d")) & F.col("a.t").eqNullSafe(F.col("b.t")))
        pairs = pairs.union(same.select("doc_id", "dup_of").distinct())
    return pairs.where("doc_id <> dup_of")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """The documents with one row per text: that of the smallest id, all columns.

    A null id counts as larger than any; rows that still tie go by their other
    columns' hash. Null texts are equal to each other, and so are empty ones.
    Columns and their types stay as they are; an empty table gives no rows.
    Texts pass a shuffle once, and only those whose digest is repeated.
    """
    names.col(docs, doc_id)
    unique, suspects = _split(docs, text, broadcast_mb)
    place = next(c for c in docs.columns if c.lower() == doc_id.lower())
    rank = F.struct(F.col("_row")[place].isNull().alias("a"), F.col("_row")[place].alias("b"), F.xxhash64(F.to_json("_row")).alias("c"))
    first = suspects.groupBy("d", "t").agg(F.min_by("_row", rank).alias("_row"))
    cols = [F.col("t").alias(c) if c.lower() == text.lower() else F.col("_row")[c].alias(c) for c in docs.columns]
    return unique.select(*cols).unionByName(first.select(*cols))
