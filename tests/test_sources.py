import json

from kgloom.sources import graph_folder, linkage, text, wiki
from tests.conftest import rows

DUMP = """<mediawiki><page><title>A B</title><ns>0</ns><id>1</id>
<revision><id>10</id><timestamp>2020-01-01T00:00:00Z</timestamp><text>x {{Infobox p |name = {{n}} |born=1}} y</text></revision>
<revision><id>11</id><timestamp>2020-01-02T00:00:00Z</timestamp><text>{{Infobox broken</text></revision></page>
<page><title>T</title><ns>10</ns><id>2</id><revision><id>12</id><timestamp>2021-01-01T00:00:00Z</timestamp><text></text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    r = wiki.revisions(wiki.read_dump(spark, f"{tmp_path}/d.xml"))
    assert rows(r.select("pid", "rid", "ts", "ns")) == [(1, 10, 1577836800, 0), (1, 11, 1577923200, 0), (2, 12, 1609459200, 10)]
    got = wiki.with_templates(r).select("rid", "templates").collect()
    assert [(x.rid, [t.content for t in x.templates]) for x in got] == [(10, ["{{Infobox p |name = {{n}} |born=1}}"])]
    assert rows(wiki.field_triples(r, "e:")) == [(1, 10, "e:A_B", "e:property/born", '"1"')]
    pages = spark.createDataFrame([(p,) for p in DUMP.replace("<mediawiki>", "").split("</page>")[:2]], "xml string")
    pages = pages.selectExpr("xml || '</page>' AS xml")
    assert rows(wiki.enriched(wiki.split_pages(pages)).select("pid", "rid", "ts", "ns")) == rows(r.select("pid", "rid", "ts", "ns"))


def test_templates_with_many_braces_are_linear():
    assert wiki.templates_in("{{" * 50_000 + "{{Infobox a}}", "Infobox")[0][2] == "{{Infobox a}}"


def test_json_graph_drops_dangling_edges(spark, tmp_path):
    (tmp_path / "vertices.json").write_text("\n".join(json.dumps({"id": i, "data_io": {"srcId": s, "recId": "r", "n": "v"}}) for i, s in (("1", "A"), ("2", "B"), ("3", "C"))))
    (tmp_path / "edges.json").write_text("\n".join(json.dumps({"source": a, "target": b, "data_io": {"value": 0.5}}) for a, b in (("1", "2"), ("1", "9"), ("2", "3"))))
    e, links = graph_folder.read_graph(spark, str(tmp_path))
    assert rows(e.select("identifier", "source")) == [("1", "A"), ("2", "B"), ("3", "C")] and e.first().properties == {"recId": "r", "n": "v"}
    assert rows(links) == [("1", "2", 0.5), ("2", "3", 0.5)]
    assert rows(graph_folder.read_graph(spark, str(tmp_path), sources=("A", "B"))[1]) == [("1", "2", 0.5)]


def test_csv_graph_unescapes(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("v;A;gtId:string,na\\:me:string,age:int\n")
    (tmp_path / "vertices.csv").write_text("1;g;A;7|a\\;b\\|c|-1\n2;g;A;8||\n")
    (tmp_path / "edges.csv").write_text("e;g;1;2;x;0.25\ne;g;1;5;x;1\n")
    e, links = graph_folder.read_graph(spark, str(tmp_path))
    assert {r.identifier: r.properties for r in e.collect()} == {"1": {"recId": "7", "na:me": "a;b|c", "age": "-1"}, "2": {"recId": "8"}}
    assert rows(links) == [("1", "2", 0.25)]


def test_linkage_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,\"caf\xe9, x\"\n2,\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("id,name\n1,é\n")
    a = linkage.read_table(spark, f"{tmp_path}/a.csv", "A")
    assert {r.identifier: r.properties for r in a.collect()} == {"1": {"name": "café, x"}, "2": {}}
    assert linkage.read_table(spark, f"{tmp_path}/b.csv", "B").first().properties == {"name": "é"}
    p = spark.createDataFrame([(1, "t", None, 2, "u", "d", 1), (1, "t", None, 3, None, "d", 0)], "id_left int, title_left string, description_left string, id_right int, title_right string, description_right string, label int")
    e, pairs = linkage.product_pairs(p)
    assert rows(pairs) == [("1", "2", True), ("1", "3", False)] and e.count() == 3
    assert rows(linkage.gold_pairs(pairs, e.where("identifier <> '2'"))) == []


def test_facts_from_text(spark, tmp_path):
    row = {"head": "h", "rel": "r", "tail": '"a, b"', "rStart": "1", "rEnd": "2", "tStart": "5", "tEnd": "x"}
    (tmp_path / "f.json").write_text(json.dumps(row))
    assert rows(text.read_facts(spark, f"{tmp_path}/f.json", "json")) == [("h", "r", '"a, b"', "1", "2", 5, None)]
    raw = spark.read.json(f"{tmp_path}/f.json")
    assert text.rejected(raw).count() == 1
    text.write_report(raw, str(tmp_path), "report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == 1
    assert text.convert(spark, f"{tmp_path}/report", f"{tmp_path}/pq", "csv") == 1


def test_turtle():
    import pytest

    from kgloom.sources.ontology import parse_turtle

    doc = '''@prefix ex: <http://ex.org/> . @base <http://b.org/> . # comment
    ex:a a ex:C ; ex:p "x"@en-GB, """long "quoted"
text""", 'single', 5, -1.5, 2e3, true, <rel> ; .
    [] ex:q ( ex:a "b" ) . _:n ex:r [ ex:s ex:t ] .'''
    got = parse_turtle(doc, "f")
    assert ("<http://ex.org/a>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://ex.org/C>", False) in got
    x = "http://www.w3.org/2001/XMLSchema#"
    assert [o for s, p, o, _ in got if p == "<http://ex.org/p>"] == ['"x"@en-GB', '"long \\"quoted\\"\\ntext"', '"single"', f'"5"^^<{x}integer>', f'"-1.5"^^<{x}decimal>', f'"2e3"^^<{x}double>', f'"true"^^<{x}boolean>', "<http://b.org/rel>"]
    assert sum(p.endswith("#first>") for _, p, _, _ in got) == 2 and ("_:fn", "<http://ex.org/r>") in [(s, p) for s, p, _, _ in got]
    assert parse_turtle("") == []
    for bad in ("ex:a a ex:b .", "<a> <b> .", "<a> <b> <c>", "<a> <b> \"x .", "@prefix ex: 5 ."):
        with pytest.raises(ValueError):
            parse_turtle(bad)


def test_bundle_and_endpoints(spark, tmp_path):
    import pytest

    from kgloom.sources import bundle

    sub = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "split int, s string")
    t = spark.createDataFrame([("a", "p", "x", False), ("b", "p", "a", False), ("c", "p", "a", False)], "s string, p string, o string, isLiteral boolean")
    texts = spark.createDataFrame([("a", "text"), ("b", ""), ("c", None)], "s string, text string")
    got = rows(bundle.write_bundle(str(tmp_path / "b"), sub, t, texts))
    assert (0, "seed", 1, 1) in got and (1, "rdf", 2, 2) in got and (1, "reference", 2, 2) in got and (0, "text", 1, 1) in got and (1, "text", 1, 1) in got
    with pytest.raises(Exception):
        bundle.write_bundle(str(tmp_path / "b"), sub, t, texts)
    assert wiki.expand_endpoints(["h:1-3/x", "h:9"]) == ["h:1/x", "h:2/x", "h:3/x", "h:9"]
    with pytest.raises(ValueError):
        wiki.with_endpoint(sub, [])
    with pytest.raises(ValueError):
        text.write_extraction(t, str(tmp_path / "e"), "xml")


def test_nested_objects_end_at_the_depth(spark):
    from kgloom.operators import triples as tr

    t = spark.createDataFrame([("a", "p", "b", False), ("b", "p", "a", False), ("b", "q", '"x"', True)], "s string, p string, o string, isLiteral boolean")
    got = {r.s: json.loads(r.json) for r in tr.nested(t, 1).collect()}
    assert got["a"] == {"@id": "a", "p": [{"@id": "b", "p": ["a"], "q": ['"x"']}]} and got["b"]["p"][0] == {"@id": "a", "p": ["b"]}


def test_too_many_paths_are_an_error(spark):
    import pytest

    from kgloom.operators import graph

    layers = [(f"{k}{x}", f"{k - 1}{y}") for k in range(1, 5) for x in "ab" for y in "ab"]
    parents = spark.createDataFrame(layers, "class string, parent string")
    members = spark.createDataFrame([(f"{k}{x}", "d") for k in range(5) for x in "ab"], "class string, domain string")
    assert graph.hierarchy_lines(parents, members).count() == 2 + 4 + 8 + 16 + 32
    with pytest.raises(ValueError):
        graph.hierarchy_lines(parents, members, most=20)
