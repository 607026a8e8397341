from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import sharding


def test_matrix_has_exact_sums_and_its_law():
    sizes, places = np.array([5, 0, 7, 3, 9]), np.array([6, 6, 6, 6])
    for seed in range(20):
        m = np.array([sharding.matrix_row(sizes, places, b, seed) for b in range(5)])
        assert (m >= 0).all() and (m.sum(1) == sizes).all() and (m.sum(0) == places).all()
    cell = [sharding.matrix_row(sizes, places, 4, s)[0] for s in range(4000)]
    assert abs(np.mean(cell) - 9 * 6 / 24) < 0.06  # of the hypergeometric distribution
    assert abs(np.var(cell) - 9 * (6 / 24) * (18 / 24) * (15 / 23)) < 0.1


@pytest.mark.parametrize("part_rows", [1 << 17, 16])
def test_every_row_once_in_shards_of_exact_sizes(spark, sf, part_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("shard", F.lit("x"))
    n = docs.count()
    got = sharding.shuffle_into_shards(docs, 7, seed=5, block_rows=64, part_rows=part_rows)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    size = Counter(r.shard for r in rows)
    assert [size[i] for i in range(7)] == [n // 7 + (i < n % 7) for i in range(7)]
    for i in range(7):
        assert sorted(r.shard_position for r in rows if r.shard == i) == list(range(size[i]))
    again = {r.doc_id: (r.shard, r.shard_position) for r in sharding.shuffle_into_shards(docs, 7, seed=5, block_rows=64, part_rows=part_rows).collect()}
    assert again == {r.doc_id: (r.shard, r.shard_position) for r in rows}
    other = {r.doc_id: (r.shard, r.shard_position) for r in sharding.shuffle_into_shards(docs, 7, seed=6, block_rows=64, part_rows=part_rows).collect()}
    assert other != again


def test_rows_that_come_from_no_file(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x" * 100_000)], "doc_id long, text string")
    rows = sharding.shuffle_into_shards(df, 5).collect()
    assert sorted(r.shard for r in rows) == [0, 1, 2] and {r.shard_position for r in rows} == {0}
    assert sharding.shuffle_into_shards(df.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(df, 0)


def plain(blocks, shards, seed, parts_of):
    """The shuffle written out: every block's rows permuted and dealt by its row of the whole matrix, shards permuted."""
    total = sum(map(len, blocks))
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    parts = parts_of(total)
    places = [n // parts + (k < n % parts) for n in sizes for k in range(parts)]
    held = [[] for _ in places]

    def draw(lo, hi, left):  # how many of blocks lo..hi's rows go to each part
        if hi - lo == 1:
            order = np.random.default_rng([seed, 1, lo]).permutation(len(blocks[lo]))
            ends = np.cumsum(left)
            for row, at in enumerate(order):
                held[int(np.argmax(ends > at))].append((lo, row))
            return
        mid = (lo + hi) // 2
        one = sharding.split_places(np.random.default_rng([seed, 0, lo, hi]), np.array(left), sum(map(len, blocks[lo:mid])))
        draw(lo, mid, one.tolist())
        draw(mid, hi, (np.array(left) - one).tolist())

    draw(0, len(blocks), places)
    return [[x for k in range(parts) for x in held[i * parts + k]] for i in range(shards)]


@pytest.mark.parametrize("part_rows", [1 << 15, 16])
def test_against_the_shuffle_written_out(spark, tmp_path, part_rows):
    import math

    blocks = [list(range(100 * b, 100 * b + n)) for b, n in enumerate((70, 1, 64, 33))]
    for b, ids in enumerate(blocks):
        spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t" / f"f={b}"))
    docs = spark.read.parquet(str(tmp_path / "t")).select("doc_id")
    want = plain(blocks, 5, 11, lambda n: max(1, math.ceil(n / 5 / part_rows)))
    got = [[] for _ in range(5)]
    for r in sharding.shuffle_into_shards(docs, 5, seed=11, block_rows=1000, part_rows=part_rows).orderBy("shard", "shard_position").collect():
        got[r.shard].append(r.doc_id)
    assert [sorted(x) for x in got] == [sorted(blocks[b][r] for b, r in x) for x in want]


def test_seed_alone_determines_the_result(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id").repartition(3)
    one, two = ([tuple(r) for r in sharding.shuffle_into_shards(df, 4, seed=3).orderBy("shard", "shard_position").collect()] for _ in range(2))
    assert one == two
    places = []
    for name in ("a", "some/where/else"):
        df.write.parquet(str(tmp_path / name))
        places.append([tuple(r) for r in sharding.shuffle_into_shards(spark.read.parquet(str(tmp_path / name)), 4, seed=3).orderBy("shard", "shard_position").collect()])
    assert places[0] == places[1]


def test_order_within_a_shard_is_uniform(spark):
    df = spark.range(6).coalesce(1)
    first = Counter()
    for seed in range(60):
        first.update(r.id for r in sharding.shuffle_into_shards(df, 1, seed=seed).where("shard_position = 0").collect())
    assert set(first) == set(range(6)) and max(first.values()) < 25
