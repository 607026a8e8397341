"""SimHash near-duplicates, searched with BK-trees over shards of the codes.

Every document's distinct words vote on a 128-bit code. Equal codes collapse to
one node. A node goes to one shard in each of ``TABLES`` tables, named by the
18 bits that the table looks at; two codes meet in the tables whose bits they
agree on. Each shard's BK-tree keys a node's children by their integer Hamming
distance to it; a probe follows only edges within ``radius`` of its distance to
the node. All trees of a task form one forest of arrays, built and probed level
by level.

A shard's tree goes to the one task that holds the shard's probes. A broadcast
of all trees to all workers would grow with the corpus; this doesn't. A shard
that is too large for one task is split into parts, and every two parts meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.llm.counting import trim
from kgloom.llm.words import U, buffers, doc_groups, mix, word_spans
from kgloom.operators.components import connected_components
from kgloom.plans.durable import cut, without

BITS = 128
RADIUS = 18
TABLES, KEY_BITS = 70, 18
SHARD_NODES = 200_000
_SAMPLE = 32
_LANES = np.array([sum(((v >> i) & 1) << (16 * i) for i in range(4)) for v in range(16)], U)
_SECOND = U(0xD6E8FEB86659FD93)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes as n x 2 uint64, whether the text has a word) of each text."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    out, has = np.zeros((n, 2), U), np.zeros(n, bool)
    for i, j in doc_groups(offsets):
        a, b = offsets[i], offsets[j]
        doc, _, _, h = word_spans(data[a:b], offsets[i : j + 1] - a)
        if not len(h):
            continue
        with np.errstate(over="ignore"):
            key = mix(h + doc.astype(U) * _SECOND)
        _, first = np.unique(key, return_index=True)
        first.sort()
        doc, h = doc[first], h[first]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[at, len(doc)])
        # a lane counts to 65,535: longer lists are added up in parts
        part = np.concatenate([np.arange(s, s + m, 60_000) for s, m in zip(at, size)]) if size.max() > 60_000 else at
        owner = np.searchsorted(at, part, "right") - 1
        back = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for half in range(2):
            v = h if not half else mix(h ^ _SECOND)
            votes = np.empty((len(part), 64), np.int64)
            for k in range(16):
                lanes = np.add.reduceat(_LANES[((v >> U(4 * k)) & U(15)).astype(np.intp)], part)
                for m in range(4):
                    votes[:, 4 * k + m] = ((lanes >> U(16 * m)) & U(0xFFFF)).astype(np.int64)
            votes = np.add.reduceat(votes, back, axis=0)
            ones = 2 * votes > size[:, None]
            out[i + doc[at], half] = np.packbits(ones, axis=1, bitorder="little").view(U).ravel()
        has[i + doc[at]] = True
    return out, has


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64) + np.bitwise_count(a[:, 1] ^ b[:, 1])).astype(np.int64)


class Forest:
    """BK-trees of many shards: node ``i`` hangs at ``edge[i]`` below ``parent[i]``.

    Roots have no parent. Codes of a shard enter in their given order, each
    descending from its shard's root along the child whose edge equals its
    distance to the node, until there is none and it becomes that child.
    """

    def __init__(self, codes: np.ndarray, shard: np.ndarray, radius: int = -1):
        """``shard`` is sorted; equal values are one tree. ``met``: pairs within ``radius`` seen on the way down."""
        self.codes, self.met = codes, []
        n = len(codes)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(start, np.diff(np.r_[start, n]))
        todo = np.setdiff1d(np.arange(n), start, assume_unique=True)
        node = self.root[todo]
        while len(todo):
            d = distance(codes[todo], codes[node])
            if (d <= radius).any():
                self.met.append((todo[d <= radius], node[d <= radius]))
            slot = node * (BITS + 1) + d
            _, first, group = np.unique(slot, return_index=True, return_inverse=True)
            child = todo[first]
            self.parent[child], self.edge[child] = node[first], d[first]
            node = child[group]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, node = todo[rest], node[rest]
        kids = np.flatnonzero(self.parent >= 0)
        slots = self.parent[kids] * (BITS + 1) + self.edge[kids]
        order = np.argsort(slots, kind="stable")
        self._slots, self._kids = slots[order], kids[order]

    def settled(self, label: np.ndarray) -> np.ndarray:
        """Whether all nodes of the tree below and with each node have its label."""
        same = np.ones(len(label), bool)
        frontier = np.flatnonzero(self.parent < 0)
        order = [frontier]
        while len(frontier):
            lo = np.searchsorted(self._slots, frontier * (BITS + 1))
            m = np.searchsorted(self._slots, frontier * (BITS + 1) + BITS, "right") - lo
            frontier = self._kids[np.repeat(lo, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
            order.append(frontier)
        for nodes in reversed(order[1:]):
            up = self.parent[nodes]
            same[up[~(same[nodes] & (label[nodes] == label[up]))]] = False
        return same

    def pairs(self, radius: int, label: np.ndarray | None = None, chunk: int = 1 << 14):
        """Yields (query, node) index arrays of all pairs within ``radius``, query > node.

        With ``label``, subtrees that all bear the query's label are left out:
        they are already connected to it.
        """
        n = len(self.codes)
        settled = None if label is None else self.settled(label)
        for lo in range(0, n, chunk):
            q = np.arange(lo, min(n, lo + chunk))
            node = self.root[q]
            while len(q):
                keep = node < q  # what hangs below a later node is later still
                if label is not None:
                    keep &= ~(settled[node] & (label[node] == label[q]))
                q, node = q[keep], node[keep]
                d = distance(self.codes[q], self.codes[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                base = node * (BITS + 1)
                a = np.searchsorted(self._slots, base + np.maximum(d - radius, 0))
                m = np.searchsorted(self._slots, base + np.minimum(d + radius, BITS), "right") - a
                q = np.repeat(q, m)
                node = self._kids[np.repeat(a, m) + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)]


def _spanning(n: int, pair_lists) -> np.ndarray:
    """Smallest connected index for each of n nodes."""
    label = np.arange(n)

    def find(x):
        while True:
            up = label[x]
            if (up == label[up]).all():
                return up
            label[x] = label[up]

    for a, b in pair_lists:
        while True:
            ra, rb = find(a), find(b)
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            open_ = hi != lo
            if not open_.any():
                break
            np.minimum.at(label, hi[open_], lo[open_])
    return find(np.arange(n))


def _edges(radius: int):
    """mapInArrow over rows sorted by shard: spanning edges of each shard's near pairs."""

    def solve(key, node, codes):
        order = np.lexsort((node, key))  # the smallest id of a shard is its root
        key, node, codes = key[order], node[order], codes[order]
        forest = Forest(codes, key, radius)
        label = _spanning(len(key), forest.met)
        label = _spanning(len(key), [*forest.met, *forest.pairs(radius, label)])
        move = np.flatnonzero(label != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(node[move]), pa.array(node[label[move]])], ["src", "dst"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            codes = np.column_stack([b.column(2).to_numpy().view(U), b.column(3).to_numpy().view(U)])
            if held is not None:
                key, node, codes = np.r_[held[0], key], np.r_[held[1], node], np.r_[held[2], codes]
            last = np.searchsorted(key, key[-1])  # the last shard may go on in the next batch
            held = key[last:], node[last:], codes[last:]
            if last:
                yield solve(key[:last], node[:last], codes[:last])
        if held is not None:
            yield solve(*held)
        del held
        trim()

    return run


def masks(tables: int = TABLES) -> list[tuple[int, int]]:
    """The bits (of either half) that make each table's key.

    Each of ten permutations of the 128 bits is cut into seven keys of 18. Of
    random pairs of codes at distance 18 these tables find 0.98, at 17 0.99, at
    16 0.997 and of closer ones all but one in some thousands.
    """
    rng, out = np.random.default_rng(20), []
    while len(out) < tables:
        bits = rng.permutation(BITS)
        for at in range(0, BITS - KEY_BITS + 1, KEY_BITS):
            key = sum(1 << int(b) for b in bits[at : at + KEY_BITS])
            out.append((key & (2**64 - 1), key >> 64))
    return out[:tables]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def simhash_codes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, c0, c1): the 128-bit code of each document that has a word and an id, and a hash of its text."""

    def run(batches):
        for b in batches:
            codes, has = codes_of(b.column(2))
            keep = has & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(pa.array(at)) for k in (0, 1)), *(pa.array(codes[at, k].view(np.int64)) for k in (0, 1))], ["doc_id", "digest", "c0", "c1"]
            )
        trim()

    t = names.col(docs, text)
    return docs.select(names.col(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("digest"), t.alias("text")).mapInArrow(run, "doc_id long, digest long, c0 long, c1 long")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, c0, c1) of each node in each table; keys have 32 bits, and two that collide only share a tree."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(a)).alias("a"), F.lit(_signed(b)).alias("b")) for t, (a, b) in enumerate(masks())])
    rows = nodes.select("node", "c0", "c1", F.explode(tables).alias("m"))
    key = F.xxhash64("m.t", F.col("c0").bitwiseAND(F.col("m.a")), F.col("c1").bitwiseAND(F.col("m.b")))
    return rows.select(F.shiftrightunsigned(key, 32).alias("key"), "node", "c0", "c1")


def near_edges(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Edges (src, dst) that connect all nodes (node, c0, c1) found within ``radius``.

    The tables don't depend on the number of nodes, so unchanged nodes stay
    connected as they were when others come. A shard has about one node in
    262,144 of the table. One of more than ``shard_nodes``, as told by the nodes
    of one hash class in 32, is split into parts of half that size, and every two
    parts are searched together: the same edges, in more tasks.
    """
    some = nodes.where(F.pmod(F.xxhash64("c0", "c1"), F.lit(_SAMPLE)) == 0)
    large = _keyed(some).groupBy("key").count().where(F.col("count") > max(1, shard_nodes // _SAMPLE))
    large = cut(large.select(F.col("key").alias("of"), F.ceil(F.col("count") * (2 * _SAMPLE) / shard_nodes).cast("long").alias("parts")))
    keyed = _keyed(nodes)
    n = large.count()
    if n:
        keyed = keyed.join(F.broadcast(large) if n <= 100_000 else large, F.col("key") == F.col("of"), "left")
        # part i meets parts 0 .. parts - 1, itself among them
        keyed = keyed.withColumn("i", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        pair = F.least("i", "j") * F.coalesce("parts", F.lit(1)) + F.greatest("i", "j")
        keyed = keyed.select((F.shiftleft(pair, 32) + F.col("key")).alias("key"), "node", "c0", "c1")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_edges(radius), "src long, dst long")


def near_groups(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, dup_of) for each document of a group other than its smallest id.

    A group is a connected component of documents whose codes differ in at most
    ``radius`` of 128 bits. The search finds all pairs that agree on the bits of
    one of the tables; measured recall against brute force is in the tests.

    Null, empty and wordless texts and null ids have no code and are in no
    group. Repeated rows of an id count once; of rows that share an id but not
    a text each joins its own group. Texts of any length are read whole. Other
    columns are ignored. An empty table gives no rows.
    """
    return _grouped(docs, radius, text, doc_id).groupBy("doc_id").agg(F.min("dup_of").alias("dup_of"))


def _grouped(docs: DataFrame, radius: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, digest, c0, c1, dup_of) of each row with a code whose group has a smaller id."""
    codes = cut(simhash_codes(docs, text, doc_id))
    # a node is a code: two codes under one id are two nodes
    nodes = codes.groupBy("c0", "c1").agg(F.min("doc_id").alias("least"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    comp = connected_components(near_edges(nodes.drop("least"), radius), "src", "dst")
    named = nodes.join(comp, F.col("node") == F.col("vertex"), "left").select("c0", "c1", "least", F.coalesce("component", "node").alias("group"))
    first = named.groupBy("group").agg(F.min("least").alias("dup_of"))
    return codes.join(named.join(first, "group").select("c0", "c1", "dup_of"), ["c0", "c1"]).where("doc_id <> dup_of")


def near_dedup(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each group of ``near_groups``; all columns stay.

    A row goes by its id and a hash of its text, so of several texts under an id
    only those go whose own group has a smaller id. Rows without a code stay, and
    so do repeated rows of the document that is kept. Up to ``broadcast_rows`` rows
    to remove are broadcast (16 bytes each); beyond, both sides are shuffled.
    """
    gone = _grouped(docs, radius, text, doc_id).select(F.struct("doc_id", "digest")).distinct()
    key = F.struct(names.col(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(names.col(docs, text)).alias("digest"))
    return without(docs.withColumn("_key", key), F.col("_key"), gone, broadcast_rows).select(*[f"`{c}`" for c in docs.columns])
