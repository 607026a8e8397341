from fractions import Fraction

import pytest

from kgloom.llm import mixing
from kgloom.llm.queries import MIX_WEIGHTS
from tests.llm.brute import mixture


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 97, "b": 2, "c": 1}, MIX_WEIGHTS])
def test_every_prefix_deviates_by_less_than_a_block(weights):
    slots = mixing.pfair_period(weights)
    total = sum(weights.values())
    for s, w in weights.items():
        done = 0
        for t, x in enumerate(slots * 2, 1):
            done += x == s
            assert abs(done - Fraction(w * t, total)) < 1
        assert slots.count(s) == w


ROWS = [(i, f"t{i}", ["x", "y", "z", None][i % 4 if i % 3 else 0]) for i in range(300)] + [(None, "n", "x"), (7, "again", "x"), (7, "again", "x")]


@pytest.mark.parametrize("weights", [{"x": 2, "y": 1}, {"x": 3, "y": 1, "*": 4}, {"none": 5, "z": 1, "*": 1}, {"x": 1, "y": 9, "z": 3, "*": 2}])
@pytest.mark.parametrize("bucket", [1 << 16, 4])
@pytest.mark.parametrize("go_on", [True, False])
def test_against_slot_by_slot(spark, weights, bucket, go_on):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, mix_position int").repartition(3)
    got = sorted((r.mix_position, r.mix_source, r.doc_id, r.mix_phase) for r in mixing.mix(df, weights, bucket_rows=bucket, go_on=go_on).collect())
    docs = [{"doc_id": i, "text": t, "source": s} for i, t, s in ROWS]
    if "*" not in weights:
        docs = [d for d in docs if d["source"] in weights]
    assert got == [(t, s, d["doc_id"], k) for d, s, t, k in mixture(docs, weights, go_on=go_on)] and got
    assert not go_on or len(got) == len(docs)


def test_blocks_and_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = mixing.mix(df, {"x": 1, "y": 1}, block_docs=5, go_on=False).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(len(got))) and all(len({r.mix_source for r in got[i : i + 5]}) == 1 for i in range(0, len(got), 5))
    all_ = mixing.mix(df, {"x": 1, "y": 1}, block_docs=5).collect()
    assert len(all_) == sum(r[2] in ("x", "y") for r in ROWS) and len({r.mix_position for r in all_}) == len(all_)
    assert mixing.mix(df.where("false"), {"x": 1}).count() == 0 and mixing.mix(df, {"q": 1}).count() == 0
    for bad in ({"x": 0}, {"x": 0.5}):
        with pytest.raises(ValueError):
            mixing.mix(df, bad)


def test_ranks_by_shuffle_are_the_same(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    one, two = (sorted(tuple(r)[-3:] for r in mixing.mix(df, {"x": 3, "*": 4}, bucket_rows=4, broadcast_buckets=n).collect()) for n in (1 << 20, 0))
    assert one == two and len(one) == len(ROWS)


def test_null_empty_and_long_texts_stay_whole(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "w " * 500_000, "x"), (4, "a", "y")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in mixing.mix(df, {"x": 1, "*": 1}).collect()}
    assert got == {r.doc_id: r.text for r in df.collect()}


def test_layout_in_mixture_order(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    weights = {"x": 3, "y": 1, "*": 4}
    laid = mixing.in_order(df, weights, part_rows=64)
    laid.write.parquet(str(tmp_path / "t"))
    got = [r.doc_id for f in sorted((tmp_path / "t").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    docs = [{"doc_id": i, "text": t, "source": s} for i, t, s in ROWS]
    assert laid.columns == df.columns and got == [d["doc_id"] for d, *_ in mixture(docs, weights)]
