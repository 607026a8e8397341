"""Golden values over a 13-row fixture, and properties of windows and differences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import serialize, statistics as st, temporal as tp
from kgloom.plans.durable import by_key
from kgloom.vocab import OPEN_END, PAGE_ID
from tests.conftest import rows

DAY = 86400


@pytest.fixture(scope="module")
def facts(spark):
    data = [
        ("s1", "r1", "t1", 0, 1000), ("s1", "r1", "t2", 1000, 2000), ("s1", "r1", "t3", 2000, 3000), ("s1", "r2", "t4", 0, 3000),
        ("s2", "r1", "t1", 0, 1000), ("s2", "r1", "t2", 1000, 2000), ("s2", "r1", "t1", 2000, 3000), ("s2", "r1", "t5", 5 * DAY, OPEN_END),
        ("s3", PAGE_ID, '"7"', 0, OPEN_END),
    ]
    return spark.createDataFrame([(h, r, t, str(a), str(z), a, z) for h, r, t, a, z in data], "head string, rel string, tail string, rStart string, rEnd string, tStart long, tEnd long")


def test_counts(facts):
    assert rows(st.unique_windows(facts)) == [(6,)]
    assert rows(st.triples_per_subject(facts)) == [("s1", 4), ("s2", 3), ("s3", 1)]
    assert rows(st.revisions_per_page(facts)) == [("s3", 1)]
    assert ("s2", "r1", 3, 4) in rows(st.changes_per_predicate(facts))
    assert rows(st.window_hours(facts)) == [(0, 7)]
    assert rows(st.triples_over_time(facts, end=True)) == [("1970", 7), ("open", 2)]
    assert st.summary(facts).first().asDict() == {"triples": 9, "distTriples": 8, "distEntities": 3, "distTypes": 0, "distRelations": 3, "distVersions": 6}


def test_snapshots_differ_at_the_end_of_a_window(facts):
    assert tp.snapshot(facts, 1000).count() == 4 and tp.snapshot(facts, 1000, closed=True).count() == 6


def test_diff_balances(facts):
    a, b = tp.snapshot(facts, 500), tp.snapshot(facts, 2500)
    diff = tp.snapshot_diff(a, b)
    n = lambda df: df.select("head", "rel", "tail").distinct().count()
    assert n(a) + diff.where("diff = 1").count() - diff.where("diff = -1").count() == n(b)


def test_null_terms_count_as_added_and_deleted(spark, facts):
    odd = spark.createDataFrame([("x", "r", None)], "head string, rel string, tail string")
    assert rows(tp.snapshot_diff(odd, odd)) == [("x", "r", None, -1), ("x", "r", None, 1)]


def test_results_do_not_depend_on_the_session_zone(spark, facts):
    try:
        want = rows(st.changes_over_time(facts))
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert rows(st.changes_over_time(facts)) == want and ("1970-01-01 00:00:00", 4) in want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_open_ends_are_written_as_the_last_second(facts):
    lines = [r.value for r in serialize.nquads(facts).collect()]
    assert len(lines) == 27 and sum("9999-12-31T23:59:59" in x for x in lines) == 2
    assert sum(x.startswith("<s3>") and x.endswith(f'> "7" <{serialize.TKG}0-{OPEN_END}> .') for x in lines) == 1


def brute_windows(versions, triples):
    out = []
    for pid in {v[0] for v in versions}:
        held = {}
        for _, rid, ts, ok in sorted((v for v in versions if v[0] == pid), key=lambda v: (v[2], v[1])):
            if not ok:
                continue
            now = {t[2:] for t in triples if t[:2] == (pid, rid)}
            for t in [t for t in held if t not in now]:
                out.append((*t, str(held[t][0]), str(rid), held[t][1], ts)), held.pop(t)
            for t in now:
                held.setdefault(t, (rid, ts))
        out += [(*t, str(r), str(OPEN_END), ts, OPEN_END) for t, (r, ts) in held.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_against_replay(spark, seed):
    rng = random.Random(seed)
    versions = [(p, p * 100 + i, rng.randrange(50), rng.random() < 0.8) for p in range(4) for i in range(12)]
    triples = [(p, r, f"s{p}", "rel", f"t{k}") for p, r, _, _ in versions for k in range(4) if rng.random() < 0.5]
    v = spark.createDataFrame(versions, "pid long, rid long, ts long, ok boolean")
    t = spark.createDataFrame(triples + triples[:5], "pid long, rid long, head string, rel string, tail string")
    assert rows(tp.windows(v, t)) == brute_windows(versions, triples)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert [(r.x, r.n) for r in serialize.numbered(df, ["x"]).orderBy("x").collect()] == [(i, i) for i in range(1000)]


def test_quartiles_are_exact(spark):
    far = spark.range(0, 60_000, 1, 3).select((F.col("id") * 70_001).alias("tEnd"), F.lit(0).cast("long").alias("tStart"))
    r = st.activity_span(far.union(spark.createDataFrame([(OPEN_END, 0), (5, 9)], "tEnd long, tStart long"))).first()
    at = lambda p: (math.ceil(60_001 * p) - 1) * 70_001
    assert (r.q25, r.median, r.q75, r.min, r.max) == (at(0.25), at(0.5), at(0.75), 0, OPEN_END)
    one = st.activity_span(spark.createDataFrame([(3, 1)], "tEnd long, tStart long"), by_year=True).first()
    assert (one.year, one.mean, one.median, one["std"], one.q75) == (1970, 2.0, 2, None, 2)


def test_parts_follow_the_files(spark, tmp_path):
    spark.range(50_000).select(F.col("id").cast("string").alias("head"), F.lit("r").alias("rel"), F.col("id").cast("string").alias("tail"), F.col("id").alias("tStart")).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    assert by_key(f, "head", part_bytes=20_000).rdd.getNumPartitions() > 8 and by_key(f, "head").rdd.getNumPartitions() == f.rdd.getNumPartitions()
    assert by_key(f, "head", part_bytes=20_000, most=6).rdd.getNumPartitions() == 6 and st.triples_over_time(f).first()["count"] == 50_000


def test_changes_are_counted_without_copies_of_the_rows(spark):
    f = spark.createDataFrame([("a", "r", "x", "1", "2"), ("a", "r", "x", "1", None), ("a", "r", None, "1", "2"), ("a", "r", "y", "3", "2"), ("b", "r", None, None, "1")], "head string, rel string, tail string, rStart string, rEnd string")
    df = st.changes_per_predicate(f)
    assert sorted(map(tuple, df.collect())) == [("a", "r", 2, 2)] + [("b", "r", 0, 0)] and "Expand" not in df._jdf.queryExecution().toString()
