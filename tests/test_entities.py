import pytest
from pyspark.sql import functions as F

from kgloom import catalog
from kgloom.catalog.views import entities
from kgloom.operators import entities as en, graph
from tests.conftest import rows
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def e(spark):
    data = [("1", "A", {"name": "x", "age": "3"}), ("2", "A", {"name": None}), ("3", "B", {"age": "3"}), ("4", "B", {})]
    return spark.createDataFrame(data, "identifier string, source string, properties map<string,string>")


def test_filters_tell_absent_from_null(e):
    ids = lambda df: [r[0] for r in rows(df.select("identifier"))]
    assert ids(en.filter_entities(e, {"age": "3"})) == ["1", "3"]
    assert ids(en.filter_entities(e, {"name": None})) == ["2"]
    assert ids(en.filter_entities(e, {"name": "x", "age": "3"})) == ["1"]
    assert [r.properties for r in en.project_entities(e, ["age", "no"]).orderBy("identifier").collect()] == [{"age": "3"}, {}, {"age": "3"}, {}]


def test_missing_properties_join_each_other(e):
    assert rows(en.join_entities(e, e, "name")) == [("1", "1")] + [(a, b) for a in "234" for b in "234"]
    assert ("2", None) in rows(en.join_entities(e, e.where("identifier = '1'"), "name", "left"))
    with pytest.raises(ValueError):
        en.join_entities(e, e, "name", "outer")
    assert rows(en.missing_counts(e)) == [("age", 2), ("name", 2)]
    assert rows(en.entity_statistics(e)) == [(4, 3, 1)]


def test_classes_hold_the_pairs_of_the_join(spark, e):
    few = e.where("identifier <> '4'")
    for a, b, key, how in ((e, e, "name", "inner"), (e, few, "age", "left"), (few, e, "age", "inner"), (e, e.where("identifier = '1'"), "name", "left"), (e, e.where("false"), "age", "left")):
        c = rows(en.entity_classes(a, b, key, how))
        pairs = [(x[1], y[1]) for x in c for y in c if x[0] == "left" and y[0] == "right" and x[2] == y[2]] + [(x[1], None) for x in c if x[0] == "left" and not x[3]]
        assert sorted(pairs, key=repr) == rows(en.join_entities(a, b, key, how)) and sum(x[3] for x in c if x[0] == "right") == sum(x[3] for x in c if x[0] == "left")


@pytest.mark.parametrize("name", ["j6_entity_join_inner", "j6_entity_join_left"])
def test_entity_joins_have_a_row_an_entity(spark, sf, name):
    assert compare(spark, duck(sf), catalog.queries()[name], catalog.oracle_sql()[name], sf) is None
    got = catalog.queries()[name](spark, sf)
    assert got.groupBy("side", "identifier").count().where("count > 1").isEmpty() and got.count() <= 2 * entities(spark, sf).count()


def test_pair_metrics(spark):
    p = spark.createDataFrame([("train", "1", "2", True, 0.9), ("train", "1", "3", False, 0.1), ("test", "2", "3", None, None)], "split string, id1 string, id2 string, is_match boolean, confidence double")
    assert ("total", 3, 1, 1, 1, 1 / 3, 1 / 3, 1 / 3) in rows(en.pair_metrics(p)) and ("train", 2, 1, 1, 0, 0.5, 0.5, 0.0) in rows(en.pair_metrics(p))
    assert rows(en.dataset_counts(p)) == [(2, 3)]


def test_clusters_and_links(spark, e):
    edges = spark.createDataFrame([("1", "3", 0.9), ("3", "1", 0.2), ("1", "4", 0.9), ("2", "3", 0.5), ("7", "8", 0.1), ("9", "9", 1.0)], "src string, dst string, sim double")
    assert rows(graph.similarity_graph(edges)) == [("1", "3", 0.9), ("1", "4", 0.9), ("2", "3", 0.5), ("7", "8", 0.1)]
    assert rows(graph.clusters(edges)) == [("1", "1"), ("2", "1"), ("3", "1"), ("4", "1"), ("7", "7"), ("8", "7"), ("9", "9")]
    links = rows(graph.filter_links(edges, e.select("identifier", "source"), normal=True))
    assert links == [("1", "3", 0.9, "strong"), ("1", "4", 0.9, "strong"), ("2", "3", 0.5, "normal")]
    members = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "1")], "cluster_id string, entity_id string")
    merged = graph.merge_clusters(members, spark.createDataFrame([("b", "a")], "cluster_id string, into string"))
    assert rows(merged) == [("a", "1"), ("a", "2")]
    assert graph.add_members(members, "a", ["1", "5"]).count() == 4 and graph.delete_cluster(members, "b").count() == 1
    assert graph.remove_members(members, "b", ["1"]).count() == 2
    with pytest.raises(ValueError):
        graph.create_cluster(members, "a", ["3"])


def test_long_path_is_one_component(spark):
    path = spark.range(300).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    assert graph.clusters(path.withColumn("sim", F.lit(1.0))).select("cluster_id").distinct().count() == 1


def test_distances_stop_at_cycles(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b")], "class string, parent string")
    anchors = spark.createDataFrame([("X", "a")], "domain string, class string")
    assert rows(graph.anchor_distances(parents, anchors)) == [("a", "X", 0), ("b", "X", 1), ("c", "X", 2), ("d", "X", 2)]


def test_fusion_and_splits(spark, e):
    m = spark.createDataFrame([("k", 1, "b"), ("k", 3, "a")], "cluster_id string, n int, name string")
    assert rows(en.fuse(m, {"n": "average", "name": "concat"})) == [("k", 2.0, "a|b")]
    with pytest.raises(ValueError):
        en.fuse(m, {"n": "median"})
    with pytest.raises(ValueError):
        en.split_of(F.col("x"), {"train": 0.5})
    assert rows(en.overlap(e.select("source"), e.where("source = 'A'").select("source"))) == [(2, 1, 0.5)]
