import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import exact
from tests.llm.brute import one_of_each_text


def test_filter_inserts_deletes_and_grows():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    f = exact.CuckooFilter(16)
    for part in np.array_split(keys, 37):
        assert f.insert(part).all()
    assert f.contains(keys).all() and f.size == len(keys) and not f.insert(keys[:500]).any()
    assert np.array_equal(np.sort(f.live()), np.sort(keys))
    assert f.delete(keys[:9000]).all() and not f.delete(keys[:10]).any()
    assert not f.contains(keys[:9000]).any() and f.contains(keys[9000:]).all()
    other = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert f.contains(other, verify=False).mean() < 0.001 and not f.contains(other).any()


def test_index_tells_equal_digests_apart():
    i = exact.ExactIndex(lambda t: len(t))
    assert i.add(1, "ab") is None and i.add(2, "cd") is None and i.add(3, "ab") == 1
    assert i.remove("ab") and not i.remove("ab") and i.add(4, "cd") == 2 and i.add(5, "ab") is None


ROWS = [(5, "a"), (3, "a"), (None, "a"), (3, "a"), (4, "A"), (7, ""), (8, ""), (9, None), (10, None), (11, "long " * 50_000), (12, "long " * 50_000), (13, "u"), (None, None)]


@pytest.mark.parametrize("mb", [64, -1])
def test_pairs_and_survivors(spark, mb):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, dup_of int").repartition(3)
    assert sorted(tuple(r) for r in exact.exact_duplicates(df, broadcast_mb=mb).collect()) == [(5, 3), (8, 7), (10, 9), (12, 11)]
    kept = exact.exact_dedup(df, broadcast_mb=mb)
    assert kept.columns == df.columns
    want = one_of_each_text([{"doc_id": i, "text": t} for i, t in ROWS])
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == sorted((d["doc_id"], d["text"]) for d in want if d["text"] is not None)
    empty = df.where("false")
    assert exact.exact_duplicates(empty).count() == 0 and exact.exact_dedup(empty).count() == 0


def test_equal_digests_of_unequal_texts_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(F.coalesce(c[0] if not isinstance(c[0], str) else F.col(c[0]), F.lit("???"))).cast("long"))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd"), (5, None), (6, "xyz"), (7, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in exact.exact_duplicates(df).collect()) == [(3, 1), (4, 2), (7, 5)]


def test_filters_find_what_a_count_finds(spark):
    texts = [f"t{i % 700}" if i % 3 else "hot" for i in range(3000)] + [f"once {i}" for i in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = sorted(r.digest for r in exact.repeated_digests(df).collect())
    want = sorted(r.d for r in df.groupBy(F.xxhash64("text").alias("d")).count().where("count > 1").collect())
    assert got == want and len(got) == len(set(got))


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    for f in (exact.exact_dedup, exact.exact_duplicates):
        with pytest.raises(ValueError):
            f(df).collect()
