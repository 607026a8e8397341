import pytest
from pyspark.sql import functions as F

from kgloom import schema
from kgloom.functions import literals as lit
from kgloom.operators import layout, sampling, triples as tr
from kgloom.operators.schema_graph import schema_graph
from kgloom.sources import text
from kgloom.vocab import DBO, RDF_TYPE
from tests.conftest import rows

A, B = f"<{DBO}A>", f"<{DBO}B>"


@pytest.fixture(scope="module")
def t(spark):
    data = [
        ("<x>", RDF_TYPE, A), ("<x>", RDF_TYPE, B), ("<y>", "a", B), ("<z>", f"<{DBO}p>", "<x>"), ("<x>", f"<{DBO}p>", "<y>"), ("<x>", f"<{DBO}p>", "<y>"),
        ("<x>", f"<{DBO}q>", '"v"@en'), ("<y>", f"<{DBO}p>", "<gone>"), ("<z>", None, "<x>"),
    ]
    return spark.createDataFrame([(s, p, o, o.startswith('"')) for s, p, o in data], "s string, p string, o string, isLiteral boolean")


def test_types_keep_multiplicity_and_only_the_written_out_predicate(t):
    assert tr.with_types(t, [A, B]).count() == 5
    assert tr.with_types(t, [B]).where("s = '<y>'").count() == 0
    assert tr.with_all_types(t, [A, B]).count() == 5
    assert tr.only_types(t, [A]).count() == 7  # the other type and the null predicate go


def test_objects_and_subgraph(t):
    assert tr.connected_objects(t).where("o = '<gone>'").count() == 0
    assert rows(tr.class_subgraph(t, [B]).select("s", "o")) == [("<x>", '"v"@en'), ("<x>", B), ("<x>", "<y>"), ("<y>", B)]
    with pytest.raises(ValueError):
        tr.class_subgraph(t, ["  "])


def test_schema_graph_multiplies_types(t):
    got = {tuple(r)[:3]: r.Count for r in schema_graph(t).collect()}
    assert got[(A, f"<{DBO}p>", B)] == 2 and got[("Untyped", f"<{DBO}p>", A)] == 1 and got[(B, f"<{DBO}p>", "Untyped")] == 1 and got[(A, f"<{DBO}q>", "Literal")] == 1


def test_samples_are_stable_and_bounded(t):
    one = rows(sampling.sample_global(t, 2, related=1))
    assert one == rows(sampling.sample_global(t.repartition(5), 2, related=1))
    assert sampling.sample_global(t, 0).count() == 0
    got = sampling.sample_type_targets(t, {A: 1, B: 2, "<no>": 3})
    assert {r.s for r in got.collect()} == {"<x>", "<y>"}
    for bad in (lambda: sampling.sample_global(t, -1), lambda: sampling.sample_all_types(t, 1, -1), lambda: sampling.sample_type_targets(t, {A: -1})):
        with pytest.raises(ValueError):
            bad()


def test_lines_round_trip(spark, t):
    from kgloom.operators.serialize import ntriples

    whole = t.where("p is not null")
    assert rows(text.parse_ntriples(ntriples(whole))) == rows(whole)
    odd = spark.createDataFrame([("# c .",), ("<a> <b> .",), ("<a>\t<b>\t<c>.",), ("<a> <b> <c> <g> .",), ('<a> <b> "x y."@en .',), ("",), (None,)], "value string")
    assert rows(text.parse_ntriples(odd).select("o")) == [('"x y."@en',), ("<c> <g>",), ("<c>",)]
    assert rows(text.unwrapped(odd).select("tail")) == [('"x y."@en',), ("c",), ("c> <g",)]


def test_files_round_trip(spark, t, tmp_path):
    path = f"{tmp_path}/nt"
    whole = t.where("p is not null")
    text.write_ntriples(whole, path, "gzip")
    assert rows(text.read_ntriples(spark, path)) == rows(whole)
    with pytest.raises(Exception, match="exists"):
        text.write_ntriples(whole, path)


@pytest.mark.parametrize("name", list(layout.LAYOUTS))
def test_layouts_answer_alike(spark, t, tmp_path, name):
    whole = t.where("p is not null").distinct()
    layout.write_layout(whole, f"{tmp_path}/{name}", name)
    got = layout.read_layout(spark, f"{tmp_path}/{name}", name, predicates=[f"<{DBO}p>"], types=[A])
    want = whole.where(F.col("p") == f"<{DBO}p>")
    if "type" in name:
        want = want.where("s = '<x>'")
    assert rows(got) == rows(want)


def test_literals(spark):
    df = spark.createDataFrame([('"5"^^<int>',), ('"a\nb"@de-AT',), ('"x"',), ("<i>",)], "t string")
    c = F.col("t")
    got = df.select(lit.literal_value(c), lit.literal_lang(c), lit.literal_datatype(c), lit.literal_number(c), lit.bare(c), lit.bracketed(lit.bare(c))).collect()
    assert [tuple(r)[:4] for r in got] == [("5", None, "int", 5.0), ("a\nb", "de-AT", None, None), ("x", None, None, None), (None, None, None, None)]
    assert got[3][4] == "i" and got[3][5] == "<i>" and got[0][4] == '"5"^^<int>'


def test_schema_is_exact(spark, t):
    assert schema.require(t, schema.TRIPLES).columns == ["s", "p", "o", "isLiteral"]
    with pytest.raises(ValueError):
        schema.require(t.drop("o"), schema.TRIPLES)
    with pytest.raises(ValueError):
        schema.require(t.withColumn("g", F.lit(1)), schema.TRIPLES)


def test_rows_pass_by_hashed_keys(spark):
    """Sorted, the rows would be in the tasks' memory."""
    t = spark.createDataFrame([("<a>", tr.RDF_TYPE, "<X>", False), ("<a>", "a", "<Y>", False), ("<a>", "<p>", "<b>", False), ("<a>", "<p>", "<b>", False), ("<b>", "<p>", "<c>", False)], "s string, p string, o string, isLiteral boolean")
    for df, n in ((tr.untyped_removed(t), 4), (tr.with_types(t, ["<X>"]), 4), (tr.connected_objects(t), 4)):
        assert df.count() == n and "SortMergeJoin" not in df._jdf.queryExecution().toString()
