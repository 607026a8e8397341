"""What a task holds, reads or writes doesn't grow with the tables."""

import re

from pyspark.sql import functions as F

from kgloom.catalog import source_queries as sq
from kgloom.catalog.views import spark_view
from kgloom.operators import layout, serialize, triples as tr
from kgloom.sources import bundle, text


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_nested_objects_meet_by_subject_alone(spark, sf):
    plan = _plan(tr.nested(spark_view(spark, sf, "triples"), 2))
    assert "hashpartitioning(s#" in plan and not re.search(r"hashpartitioning\(s#\d+, p#", plan)


def test_dumps_have_as_many_files_as_the_tables_ask_for(spark, sf, monkeypatch):
    monkeypatch.setattr(sq, "parts", lambda *_: 7)
    df = sq._dump(spark, sf)
    assert len(df.inputFiles()) == 7 and df.count() == spark_view(spark, sf, "all_versions").count()


def test_quads_are_compressed(spark, sf, tmp_path):
    text.write_extraction(spark_view(spark, sf, "facts"), str(tmp_path / "q"), "ngraph")
    assert {f.suffix for f in (tmp_path / "q").glob("part-*")} == {".gz"}


def test_large_tables_are_converted_in_more_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "PART", 20_000, raising=False)
    spark.range(5000).write.json(str(tmp_path / "a"))
    assert text.convert(spark, str(tmp_path / "a"), str(tmp_path / "b"), "json", "parquet", 2) == 5000
    assert len(list((tmp_path / "b").glob("part-*"))) > 2


def test_layouts_spread_with_the_table(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "more_parts", lambda *a, **k: 12, raising=False)
    layout.write_layout(spark_view(spark, sf, "triples"), str(tmp_path / "p"), "predicate")
    assert max(len(list(d.glob("part-*"))) for d in (tmp_path / "p").glob("predicate_hash=*")) > 8


def test_a_fact_is_digested_once(spark, sf):
    for lines in (serialize.named_graphs, serialize.reification):
        assert lines(spark_view(spark, sf, "facts"))._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_a_bundle_goes_through_its_triples_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    raw = spark.sparkContext.parallelize([(f"<{i}>", "<p>", '"x"', True) for i in range(20)], 2)
    t = raw.map(lambda r: (seen.add(1), r)[1]).toDF("s string, p string, o string, isLiteral boolean")
    subsets = spark.createDataFrame([(0, "<1>"), (1, "<1>"), (1, "<2>")], "split int, s string")
    texts = spark.createDataFrame([("<1>", "one"), ("<3>", "three")], "s string, text string")
    got = {(r.part, r.split): r.rows for r in bundle.write_bundle(str(tmp_path / "b"), subsets, t, texts).collect()}
    assert seen.value == 20 and got[("rdf", 1)] == 2 and got[("reference", 1)] == 2 and got[("text", 0)] == 1


def test_a_base_result_is_worked_out_once(spark, sf, tmp_path):
    for name in layout.LAYOUTS:
        layout.write_layout(spark_view(spark, sf, "triples"), f"{tmp_path}/{name}", name)
    run = {"labels": (lambda t: t.where(F.col("isLiteral")).select("s").distinct(), None, None)}
    df = layout.overlaps(spark, str(tmp_path), run)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaves.size() == 8 and sum("/all/" in f for f in df.inputFiles()) <= len(list((tmp_path / "all").glob("part-*"))) and all(r.rows == r.shared for r in df.collect() if r.layout in ("all", "predicate"))
