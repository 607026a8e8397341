import random

import numpy as np
import pyarrow as pa

from kgloom.llm import simhash
from tests.llm.brute import near_groups, near_pairs


def test_codes_are_the_votes_of_distinct_words():
    codes, has = simhash.codes_of(pa.array(["a b c", "c B a b", "", None, "?", "a b d"]))
    assert has.tolist() == [True, True, False, False, False, True]
    assert (codes[0] == codes[1]).all() and (codes[0] != codes[5]).any()
    long = " ".join(f"w{i}" for i in range(200_000))
    one, _ = simhash.codes_of(pa.array([long]))
    two, _ = simhash.codes_of(pa.array([long + " " + long]))
    assert (one == two).all()


def test_forest_finds_all_pairs_of_each_shard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    codes = base[rng.integers(0, 40, 600)]
    for _ in range(12):
        codes[np.arange(600), rng.integers(0, 2, 600)] ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    shard = np.sort(rng.integers(0, 5, 600))
    f = simhash.Forest(codes, shard)
    kids = np.flatnonzero(f.parent >= 0)
    assert (simhash.distance(codes[kids], codes[f.parent[kids]]) == f.edge[kids]).all()
    assert len(set(zip(f.parent[kids], f.edge[kids]))) == len(kids)
    for radius in (0, 6, 18, 30):
        got = {(int(n), int(q)) for qs, ns in f.pairs(radius) for q, n in zip(qs, ns)}
        assert got == {(i, j) for i, j in near_pairs(codes, radius) if shard[i] == shard[j]}


def copies(seed):
    """Documents with copies of which some words are changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    out = []
    for g in range(150):
        base = [word() for _ in range(rng.randrange(80, 300))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(len(w) // 40):
                w[rng.randrange(len(w))] = word()
            out.append((len(out) * 3, " ".join(w)))
    rng.shuffle(out)
    return out


def test_recall_of_pairs_against_brute_force(spark):
    rows = copies(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_groups([{"doc_id": i, "text": t} for i, t in rows])
    got = {r.doc_id: r.dup_of for r in simhash.near_groups(df).collect()}
    assert len(want) > 80 and set(got) <= set(want) and len(got) >= 0.98 * len(want)


def test_tables_reach_far_pairs():
    assert len(set(simhash.masks())) == simhash.TABLES and all(a.bit_count() + b.bit_count() == simhash.KEY_BITS for a, b in simhash.masks())
    rng = random.Random(7)
    tables = [a | b << 64 for a, b in simhash.masks()]
    for d, least in ((10, 1.0), (12, 0.999), (16, 0.99), (18, 0.97)):
        flips = [sum(1 << i for i in rng.sample(range(128), d)) for _ in range(5000)]
        assert sum(any(not x & t for t in tables) for x in flips) >= least * 5000


def flipped(n, d, seed=3):
    """Pairs of codes that differ in d bits, as rows (node, c0, c1)."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        a = rng.integers(0, 256, 16, dtype=np.uint8)
        b = a.copy()
        for x in rng.choice(128, d, replace=False):
            b[x // 8] ^= np.uint8(1 << (x % 8))
        rows += [(2 * k + i, *map(int, c.view(np.int64))) for i, c in enumerate((a, b))]
    return rows


def test_tables_are_the_same_at_every_size(spark, monkeypatch):
    nodes = spark.createDataFrame(flipped(200, 18), "node long, c0 long, c1 long")
    few = {tuple(r) for r in simhash.near_edges(nodes).collect()}
    monkeypatch.setattr(type(nodes), "count", lambda self: (1 << 24) + 1)
    assert {tuple(r) for r in simhash.near_edges(nodes).collect()} == few and len(few) >= 0.9 * 200


def test_a_large_shard_is_split_to_the_same_groups(spark):
    from kgloom.operators.components import connected_components

    rng = np.random.default_rng(9)
    rows = flipped(50, 18)
    base = rng.integers(0, 2**63, 2)
    for k in range(600):  # a ball of near codes: one hot shard in every table
        c = base.copy()
        for x in rng.choice(126, 5, replace=False):
            c[x // 63] ^= np.int64(1) << np.int64(x % 63)
        rows.append((1000 + k, int(c[0]), int(c[1])))
    nodes = spark.createDataFrame(rows, "node long, c0 long, c1 long")
    groups = [sorted(tuple(r) for r in connected_components(simhash.near_edges(nodes, shard_nodes=n), "src", "dst").collect()) for n in (200_000, 64, 32)]
    assert groups[0] == groups[1] == groups[2] and sum(c == 1000 for _, c in groups[0]) == 600


def test_recall_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near_groups([r.asDict() for r in docs.collect()])
    got = {r.doc_id: r.dup_of for r in simhash.near_groups(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and want


def test_edge_cases(spark):
    t = " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(5, t, 1), (2, t + " more", 1), (2, t + " more", 1), (9, None, 1), (10, "", 1), (None, t, 1), (11, "x", 1)], "doc_id long, text string, dup_of int")
    assert [tuple(r) for r in simhash.near_groups(df).collect()] == [(5, 2)]
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2, 9, 10, 11]
    assert simhash.near_groups(df.where("false")).count() == 0


def test_removal_by_shuffle_is_the_same(spark):
    df = spark.createDataFrame(copies(4), "doc_id long, text string")
    kept = [sorted(tuple(r) for r in simhash.near_dedup(df, broadcast_rows=n).collect()) for n in (1_000_000, -1)]
    assert kept[0] == kept[1] and 100 < len(kept[0]) < df.count()


def test_each_group_keeps_a_row_where_ids_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in ("left", "right"))
    df = spark.createDataFrame([(2, a), (5, a), (2, b), (1, b), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in simhash.near_dedup(df).collect()) == [(1, b), (2, a), (5, "")]
    # two texts under an id don't join their groups
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (7, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.near_groups(df).collect()) == [(2, 1), (7, 2)]
    assert sorted(tuple(r) for r in simhash.near_dedup(df).collect()) == [(1, a), (2, b)]
