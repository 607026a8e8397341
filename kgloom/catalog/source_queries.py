"""Queries over sources, sinks and layouts: the driver's tables are written to the shared folder in each format and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from kgloom import cli
from kgloom.catalog import entity_queries as eq, fact_queries as fq, triple_queries as tq
from kgloom.catalog.views import DBO, LABEL, RDF, entities, spark_view
from kgloom.operators import graph, layout, sampling, serialize, statistics as st
from kgloom.operators.schema_graph import schema_graph
from kgloom.plans.durable import parts, shared_folder
from kgloom.sources import bundle, graph_folder, linkage, ontology, text, wiki


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


_F = "head, rel, tail, rStart, rEnd, tStart, tEnd"
#: Facts as text, some of them with a time that is no number.
_TIME = "CASE WHEN rStart LIKE '%7' THEN NULL ELSE tStart END AS tStart"


def _as_text(spark, sf, bad=False):
    f = spark_view(spark, sf, "facts")
    start = F.col("tStart").cast("string")
    return f.withColumn("tStart", F.when(F.col("rStart").endswith("7"), "soon").otherwise(start) if bad else start).withColumn("tEnd", F.col("tEnd").cast("string"))


def _facts(kind):
    def run(spark, sf):
        path = _folder(spark)
        df = _as_text(spark, sf, bad=True)
        {"parquet": df.write.parquet, "json": df.write.json, "csv": lambda p: df.write.csv(p, header=True, escape='"')}[kind](path)
        return text.read_facts(spark, path, kind) if kind != "csv" else text.as_facts(spark.read.csv(path, header=True, escape='"', unescapedQuoteHandling="BACK_TO_DELIMITER"))

    return run


def _rejected(spark, sf):
    return text.rejected(_as_text(spark, sf, bad=True)).select("head", "rel", "rStart", "tStart")


STRICT_ODD = ["<s> <p> <o> .", '<s> <p> "a\\"b"@en .', '<s> <p> "a"b" .', "<s> <p> o .", "_:b <p> _:c .", "<s> <p> <o>", '<s> <p> "x"^^<t> .']


def _strict(spark, sf):
    lines = serialize.ntriples(spark_view(spark, sf, "triples").where("p <> 'a'")).union(spark.createDataFrame([(x,) for x in STRICT_ODD], "value string"))
    return text.strict(lines.union(serialize.ntriples(spark_view(spark, sf, "triples").where("p = 'a'"))))


def _dump(spark, sf):
    """Every page in one of several dump files: three, or one for each 4 MB of the tables where those are more."""
    pages, folder = fq._pages(spark, sf), _folder(spark)
    n = max(3, parts(pages, 4 << 20))
    ends = spark.range(n).select(F.col("id").cast("int").alias("file"), F.explode(F.expr("map(0, '<mediawiki>', 2, '</mediawiki>')")).alias("k", "value"))
    mine = pages.select(F.pmod(F.xxhash64("xml"), F.lit(n)).cast("int").alias("file"), F.lit(1).alias("k"), F.col("xml").alias("value"))
    mine.union(ends).repartition(n, "file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(folder)
    return wiki.revisions(wiki.read_dump(spark, f"{folder}/file=*"))


def _compressed(spark, sf):
    t, folder = spark_view(spark, sf, "triples"), _folder(spark)
    text.write_ntriples(t.where("isLiteral"), f"{folder}/a", "gzip")
    text.write_ntriples(t.where("not isLiteral"), f"{folder}/nested/b.bz2", "bzip2")
    return text.read_ntriples(spark, [f"{folder}/a", f"{folder}/nested/b.bz2"])


_NAMES = ["name", "<market segment>", "balance", "recId"]


def _json_folder(spark, sf):
    folder = _folder(spark)
    e = entities(spark, sf)
    source = F.create_map(F.lit("srcId"), F.col("source"))
    e.select(F.col("identifier").alias("id"), F.map_concat("properties", source).alias("data_io")).write.json(f"{folder}/vertices.json")
    edges = spark_view(spark, sf, "edges").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct(F.col("sim").alias("value")).alias("data_io"))
    edges.write.json(f"{folder}/edges.json")
    return folder


def _escaped(c):
    return F.regexp_replace(c, r"([;|,:\\])", r"\\$1")


def _csv_folder(spark, sf):
    folder = _folder(spark)
    e = entities(spark, sf)
    names = [_escaped(F.lit("gtId" if n == "recId" else n)) for n in _NAMES]
    meta = F.concat(F.lit("v;"), F.col("source"), F.lit(";"), F.concat_ws(",", *[F.concat(n, F.lit(":string")) for n in names]))
    e.select("source").distinct().select(meta.alias("value")).write.text(f"{folder}/metadata.csv")
    values = F.concat_ws("|", *[_escaped(F.coalesce(F.try_element_at("properties", F.lit(n)), F.lit(""))) for n in _NAMES])
    e.select(F.concat_ws(";", "identifier", F.lit("g"), "source", values).alias("value")).write.text(f"{folder}/vertices.csv")
    spark_view(spark, sf, "edges").select(F.concat_ws(";", F.lit("e"), F.lit("g"), "src", "dst", F.lit("similar"), F.col("sim").cast("string")).alias("value")).write.text(f"{folder}/edges.csv")
    return folder


def _read(folder, part, **kw):
    return lambda spark, sf: graph_folder.read_graph(spark, folder(spark, sf), **kw)[part]


def _flat_read(folder, **kw):
    return lambda spark, sf: eq._flat(graph_folder.read_graph(spark, folder(spark, sf), **kw)[0])


def _detected(spark, sf):
    out = None
    for kind, folder in (("json", _json_folder(spark, sf)), ("csv", _csv_folder(spark, sf))):
        e, links = graph_folder.read_graph(spark, folder)
        row = e.agg(F.lit(kind).alias("kind"), F.count("*").alias("entities")).crossJoin(links.agg(F.count("*").alias("edges")))  # one row each
        out = row if out is None else out.union(row)
    return out


_PAIR = ("www.shop0.com", "www.shop3.com")
_KNOWN = "SELECT src, dst, sim FROM edges WHERE src IN (SELECT identifier FROM entity_ids{0}) AND dst IN (SELECT identifier FROM entity_ids{0})"
_IN_PAIR = f" WHERE source IN {_PAIR}"
_FULL = "(v IS NOT NULL AND v <> '')"


def _tables(spark, sf):
    """The customers as UTF-8, as UTF-8 with a byte order mark and as Latin-1, each a table of another source."""
    c = spark_view(spark, sf, "clusters").select(F.col("entity_id").alias("id"), F.concat("name", F.lit(", é ü")).alias("name"), F.col("nation").cast("string").alias("nation"))
    out = None
    for kind, encoding in (("utf8", "UTF-8"), ("bom", "UTF-8"), ("latin1", "ISO-8859-1")):
        path = _folder(spark)
        mark = "﻿" if kind == "bom" else ""
        c.coalesce(1).withColumnRenamed("id", f"{mark}id").write.csv(path, header=True, escape='"', encoding=encoding)
        e = eq._flat(linkage.read_table(spark, path, kind))
        out = e if out is None else out.union(e)
    return out


def _truth(spark, sf):
    path = _folder(spark)
    spark_view(spark, sf, "pairs").where("is_match").select(F.col("id1").alias("idAbt"), F.col("id2").alias("idBuy")).write.csv(path, header=True)
    return linkage.read_truth(spark, path, "idAbt", "idBuy")


def _products(part):
    def run(spark, sf):
        path = _folder(spark)
        p, c = spark_view(spark, sf, "pairs"), spark_view(spark, sf, "clusters").select("entity_id", "name", F.col("nation").cast("string").alias("nation"))
        rows = p.where("is_match is not null").join(c.toDF("id1", "title_left", "brand_left"), "id1").join(c.toDF("id2", "title_right", "brand_right"), "id2")
        rows = rows.select(F.col("id1").alias("id_left"), "title_left", "brand_left", F.col("id2").alias("id_right"), "title_right", F.when(F.col("brand_right") > "2", F.col("brand_right")).alias("brand_right"), F.col("is_match").cast("int").alias("label"))
        rows.write.json(path, compression="gzip")
        got = linkage.product_pairs(spark.read.json(path))[part]
        return eq._flat(got) if part == 0 else got

    return run


_PROD = """p AS (SELECT id1, id2, is_match, a.name AS n1, CAST(a.nation AS VARCHAR) AS b1, b.name AS n2, CASE WHEN CAST(b.nation AS VARCHAR) > '2' THEN CAST(b.nation AS VARCHAR) ELSE '' END AS b2
 FROM pairs JOIN clusters a ON a.entity_id = id1 JOIN clusters b ON b.entity_id = id2 WHERE is_match IS NOT NULL)"""


def _turtle(spark, sf):
    """The class hierarchy as one Turtle file, with classes, parents and labels of other kinds that a reader leaves out."""
    path = _folder(spark)
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    p = spark_view(spark, sf, "parents").select(safe("class").alias("class"), safe("parent").alias("parent")).distinct()
    head = spark.createDataFrame([(0, "@prefix dbo: <http://dbpedia.org/ontology/> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n# classes\nowl:Thing a owl:Class .")], "k int, value string")
    body = p.groupBy("class").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("dbo:"), "parent"))), ", ").alias("ps"))
    line = F.concat(F.lit("dbo:"), F.col("class"), F.lit(" a owl:Class ; rdfs:subClassOf "), F.col("ps"), F.lit(', owl:Thing, [ a owl:Restriction ; owl:maxCardinality 1 ] ;\n rdfs:label "the '), F.col("class"), F.lit('"@en , "die '), F.col("class"), F.lit('"@de , "'), F.col("class"), F.lit('" .'))
    head.union(body.select(F.lit(1), line)).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return ontology.read_turtle(spark, path)


_SAFE = "regexp_replace({}, '[^A-Za-z0-9]', '_', 'g')"
_CLS = f"(SELECT DISTINCT {_SAFE.format('class')} AS class, {_SAFE.format('parent')} AS parent FROM parents)"


def _written_lines(spark, sf):
    path = _folder(spark)
    text.write_ntriples(spark_view(spark, sf, "triples"), path)
    return spark.read.text(path)


def _schema_report(spark, sf):
    folder = _folder(spark)
    text.write_report(schema_graph(spark_view(spark, sf, "triples")), folder, "schema_graph")
    return spark.read.csv(f"{folder}/schema_graph", header=True).withColumn("Count", F.col("Count").cast("long"))


def _reports(spark, sf):
    """Two reports of one run, each under its name."""
    folder, r = _folder(spark), spark_view(spark, sf, "revisions")
    for name, what in (("revisions", "id"), ("pages", "pageid")):
        text.write_report(st.namespace_counts(r, what), folder, name)
    return spark.read.csv(f"{folder}/revisions", header=True).withColumn("report", F.lit("revisions")).union(spark.read.csv(f"{folder}/pages", header=True).withColumn("report", F.lit("pages"))).select("report", F.col("namespace").cast("int").alias("namespace"), F.col("count").cast("long").alias("count"))


def _converted(kind, to, partitions=None):
    def run(spark, sf):
        a, b = _folder(spark), _folder(spark)
        df = _as_text(spark, sf).select("head", "rel", "rStart", "tStart", "tEnd")
        {"csv": lambda: df.write.csv(a, header=True), "json": lambda: df.write.json(a), "parquet": lambda: df.write.parquet(a)}[kind]()
        n = text.convert(spark, a, b, kind, to, partitions)
        back = spark.read.options(header=True).format(to).load(b)
        return back.select("head", "rel", "rStart", "tStart", "tEnd", F.lit(n).cast("long").alias("counted"))

    return run


_CONVERTED = "SELECT head, rel, rStart, CAST(tStart AS VARCHAR) AS tStart, CAST(tEnd AS VARCHAR) AS tEnd, (SELECT count(*) FROM facts) AS counted FROM facts"


def _extraction(spark, sf):
    path = _folder(spark)
    text.write_extraction(spark_view(spark, sf, "facts").select("head", "rel", "rStart", "rEnd", "tStart", "tEnd"), path, "csv")
    return spark.read.csv(path, header=True)


def _extraction_quads(spark, sf):
    path = _folder(spark)
    text.write_extraction(spark_view(spark, sf, "facts"), path, "ngraph")
    return spark.read.text(path)


def _local_runs(spark, sf):
    """(pid, revisions, ordered) of each run of a page's revisions as tasks see them: one a page if they lie together."""

    def run(batches):
        last, n, ordered, rid = None, 0, True, None
        for b in batches:
            for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != last:
                    if n:
                        yield pa.RecordBatch.from_pylist([{"pid": last, "revisions": n, "ordered": ordered}])
                    last, n, ordered, rid = p, 0, True, None
                n, ordered, rid = n + 1, ordered and (rid is None or rid <= r), r
        if n:
            yield pa.RecordBatch.from_pylist([{"pid": last, "revisions": n, "ordered": ordered}])

    return wiki.located(spark_view(spark, sf, "all_versions").select("pid", "rid"), partitions=6).mapInArrow(run, "pid long, revisions long, ordered boolean")


ENDPOINTS = wiki.expand_endpoints(["http://one:9500-9502/server", "http://two/x"])


def _endpoints(spark, sf):
    """(endpoint, tasks, pages, split): how the pages lie; no page has two endpoints and no task serves two."""
    rows = wiki.with_endpoint(spark_view(spark, sf, "all_versions"), ENDPOINTS).withColumn("task", F.spark_partition_id())
    page = rows.groupBy("pid").agg(F.count_distinct("endpoint").alias("endpoints"), F.count_distinct("task").alias("tasks"))
    return page.groupBy("endpoints", "tasks").agg(F.count("*").alias("pages"))


_LAYOUT = {"predicate": ([f"<{DBO}nation>", f"<{LABEL}>"], None), "type": (None, [tq.COUNTRY, tq.ORDER]), "type_predicate": ([f"<{DBO}nation>", f"<{LABEL}>"], [tq.CUSTOMER]), "all": ([f"<{DBO}balance>"], None)}


def _layout(name):
    def run(spark, sf):
        path = _folder(spark)
        layout.write_layout(spark_view(spark, sf, "triples"), path, name)
        return layout.read_layout(spark, path, name, *_LAYOUT[name])

    return run


def _harness(spark, sf):
    folder = _folder(spark)
    t = spark_view(spark, sf, "triples")
    for name in layout.LAYOUTS:
        layout.write_layout(t, f"{folder}/{name}", name)
    return layout.overlaps(spark, folder, STUDY)


#: The study's star queries, with the predicates and types that each asks a layout for.
_TYPE = f"<{RDF}>"
STUDY = {
    "box": (lambda t: layout.in_box(t, tq.CUSTOMER, (0, 5000), (100, 9000), f"<{DBO}balance>", f"<{DBO}balance>"), [_TYPE, f"<{LABEL}>", f"<{DBO}balance>"], [tq.CUSTOMER]),
    "largest": (lambda t: layout.largest(t, tq.CUSTOMER, f"<{DBO}balance>"), [_TYPE, f"<{LABEL}>", f"<{DBO}balance>"], [tq.CUSTOMER]),
    "leader": (lambda t: layout.led_to(t, tq.CUSTOMER, "Customer#000000001", f"<{DBO}nation>"), [_TYPE, f"<{LABEL}>", f"<{DBO}nation>"], [tq.CUSTOMER, tq.COUNTRY]),
}


def _bundle(spark, sf):
    t = spark_view(spark, sf, "triples")
    subsets = sampling.overlapping_subsets(t, "s", k=3, size=60, overlap=0.1).select(F.col("subset").alias("split"), "s")
    texts = t.where(f"p = '<{LABEL}>'").select("s", "o").distinct().select("s", F.col("o").alias("text"))
    return bundle.write_bundle(_folder(spark), subsets, t, texts).select("split", "part", "rows", "entities")


_SUB = f"""r AS (SELECT s, row_number() OVER (ORDER BY {tq._order(42, 's')}, s) - 1 AS r FROM (SELECT DISTINCT s FROM triples) x),
sub AS (SELECT CAST(k AS INTEGER) AS split, s FROM r, range(3) g(k) WHERE r < 6 UNION ALL SELECT CAST((r - 6) // 54 AS INTEGER), s FROM r WHERE r >= 6 AND r < 168),
rdf AS (SELECT split, t.* FROM triples t JOIN sub USING (s)), txt AS (SELECT split, x.s FROM (SELECT DISTINCT s, o FROM triples WHERE p = '<{LABEL}>') x JOIN sub USING (s)),
parts AS (SELECT 'seed' AS part, split, s FROM rdf WHERE split = 0 UNION ALL SELECT 'rdf', split, s FROM rdf UNION ALL SELECT 'text', split, s FROM txt UNION ALL SELECT 'links', split, s FROM txt UNION ALL SELECT 'provenance', split, s FROM sub
 UNION ALL SELECT 'reference', CAST(k AS INTEGER), t.s FROM triples t JOIN (SELECT s, min(split) AS f FROM sub GROUP BY s) z USING (s), range(3) g(k) WHERE k >= f)"""


def _values(rows, names):
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) if isinstance(x, int) else chr(39) + x + chr(39) for x in r) + ')' for r in rows)}) v({names})"


_TERMS = ["http://ex.org/a", "http://ex.org/a*", "<http://ex.org/b>", "<http://ex.org/b", "name", " dbo* ", "name"]
_GOT = ["<http://ex.org/a>", "<http://ex.org/a*", "<http://ex.org/b>", "<http://ex.org/b*", "<name*", "<dbo*", "<name*"]
_RANGES = ["http://one:9500-9502/server", "http://two/x", "three:80", "four:7-8"]
_PORTS = ["http://one:9500/server", "http://one:9501/server", "http://one:9502/server", "http://two/x", "three:80", "four:7", "four:8"]
_SPLITS = fq.QUERIES[[q[0] for q in fq.QUERIES].index("s6_split_pages")][2]
_CLUSTERS = "SELECT cluster_id, entity_id FROM clusters"


def _members(f):
    return lambda spark, sf: f(spark_view(spark, sf, "clusters").select("cluster_id", "entity_id"))


QUERIES = [
    ("s2_strict_nt", _strict, f"""SELECT value FROM (SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM triples UNION ALL SELECT unnest([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in STRICT_ODD)}])) x
WHERE regexp_matches(value, '{text._STRICT}')"""),
    ("s3_facts_parquet", _facts("parquet"), f"SELECT head, rel, tail, rStart, rEnd, {_TIME}, tEnd FROM facts"),
    ("s3_rejected", _rejected, "SELECT head, rel, rStart, 'soon' AS tStart FROM facts WHERE rStart LIKE '%7'"),
    ("s4_facts_json", _facts("json"), f"SELECT head, rel, tail, rStart, rEnd, {_TIME}, tEnd FROM facts"),
    ("s5_facts_csv", _facts("csv"), f"SELECT head, rel, tail, rStart, rEnd, {_TIME}, tEnd FROM facts"),
    ("s7_dump_files", _dump, f"SELECT pid, rid, ts, CAST(ns AS INTEGER) AS ns, 'Page ' || pid AS title, 'some {{{{Infobox thing |state = ' || rid % 3 || ' |x={{{{nested}}}} }}}} text' AS text FROM ({fq._XML}) x"),
    ("s8_compressed_nt", _compressed, "SELECT s, p, o, isLiteral FROM triples"),
    ("s9_json_graph_vertices", _flat_read(_json_folder), eq._flat_sql()),
    ("s9_json_graph_edges", _read(_json_folder, 1), _KNOWN.format("")),
    ("s10_csv_graph_vertices", _flat_read(_csv_folder), eq._flat_sql(_FULL)),
    ("s10_csv_graph_edges", _read(_csv_folder, 1), _KNOWN.format("")),
    ("s11_source_pair_vertices", _flat_read(_csv_folder, sources=_PAIR), eq._flat_sql(_FULL, f"source IN {_PAIR}")),
    ("s11_source_pair_edges", _read(_json_folder, 1, sources=_PAIR), _KNOWN.format(_IN_PAIR)),
    ("s12_format_detected", _detected, f"SELECT kind, (SELECT count(*) FROM entity_ids) AS entities, (SELECT count(*) FROM ({_KNOWN.format('')}) x) AS edges FROM (VALUES ('json'), ('csv')) k(kind)"),
    ("s13_linkage_tables", _tables, "SELECT entity_id AS identifier, source, 'name=' || name || ', é ü|nation=' || CAST(nation AS VARCHAR) AS properties FROM clusters, (VALUES ('utf8'), ('bom'), ('latin1')) k(source)"),
    ("s14_ground_truth", _truth, "SELECT id1, id2 FROM pairs WHERE is_match"),
    ("s15_product_pairs", _products(1), f"WITH {_PROD} SELECT id1, id2, is_match FROM p"),
    ("s15_product_entities", _products(0),
     f"WITH {_PROD} SELECT DISTINCT id1 AS identifier, 'left' AS source, 'brand=' || b1 || '|title=' || n1 AS properties FROM p UNION SELECT id2, 'right', 'brand=' || b2 || '|title=' || n2 FROM p"),
    ("s17_ontology_classes", lambda spark, sf: ontology.ontology(_turtle(spark, sf))[0], f"SELECT DISTINCT class FROM {_CLS} x"),
    ("s17_ontology_parents", lambda spark, sf: ontology.ontology(_turtle(spark, sf))[1], f"SELECT class, parent FROM {_CLS} x"),
    ("s17_ontology_labels", lambda spark, sf: ontology.ontology(_turtle(spark, sf))[2], f"SELECT DISTINCT class, unnest(['the ' || class, class]) AS label FROM {_CLS} x"),
    ("k2_write_nt", _written_lines, "SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM triples"),
    ("k3_schema_graph_csv", _schema_report, tq._SCHEMA),
    ("k4_report_csv", _reports, "SELECT 'revisions' AS report, namespace, count(DISTINCT id) AS count FROM revisions GROUP BY namespace UNION ALL SELECT 'pages', namespace, count(DISTINCT pageid) FROM revisions GROUP BY namespace"),
    ("k5_csv_to_parquet", _converted("csv", "parquet"), _CONVERTED),
    ("k6_json_to_parquet", _converted("json", "parquet", 5), _CONVERTED),
    ("k7_parquet_to_csv", _converted("parquet", "csv"), _CONVERTED),
    ("k16_extraction_csv", _extraction, "SELECT head, rel, rStart, rEnd, CAST(tStart AS VARCHAR) AS tStart, CAST(tEnd AS VARCHAR) AS tEnd FROM facts"),
    ("k16_extraction_ngraph", _extraction_quads, fq.QUERIES[[q[0] for q in fq.QUERIES].index("k9_nquads")][2]),
    ("f10_terms", lambda spark, sf: spark.createDataFrame([(i, cli.term(t)) for i, t in enumerate(_TERMS)], "place int, term string"), _values(list(enumerate(_GOT)), "place, term")),
    ("u5_ordered_dedup", lambda spark, sf: spark.createDataFrame(list(enumerate(cli.unique([cli.term(t) for t in _TERMS]))), "place int, term string"), _values(list(enumerate(dict.fromkeys(_GOT))), "place, term")),
    ("j11_loaded_edges", lambda spark, sf: graph.loaded_edges(spark_view(spark, sf, "edges"), spark_view(spark, sf, "entity_ids")), _KNOWN.format("")),
    ("l7_top_properties", lambda spark, sf: st.top_properties(spark_view(spark, sf, "facts"), 3),
     fq.QUERIES[[q[0] for q in fq.QUERIES].index("a21_property_changes")][2] + " ORDER BY median DESC, rel LIMIT 3"),
    ("l8_locality", _local_runs, "SELECT pid, count(*) AS revisions, true AS ordered FROM all_versions GROUP BY pid"),
    ("t4_endpoints", _endpoints, "SELECT 1::BIGINT AS endpoints, 1::BIGINT AS tasks, count(DISTINCT pid) AS pages FROM all_versions"),
    ("t5_endpoint_list", lambda spark, sf: spark.createDataFrame(list(enumerate(wiki.expand_endpoints(_RANGES))), "place int, endpoint string"), _values(list(enumerate(_PORTS)), "place, endpoint")),
    ("t6_flat_json", lambda spark, sf: wiki.flat_json(wiki.split_pages(fq._pages(spark, sf))), f"SELECT '{{\"pagexml\":\"' || pagexml || '\",\"revisionxml\":\"' || revisionxml || '\"}}' AS value FROM ({_SPLITS}) y"),
    ("t11_outcomes", lambda spark, sf: wiki.outcomes(spark_view(spark, sf, "versions")), "SELECT CASE WHEN ok THEN 'extracted' ELSE 'failed' END AS event, count(*) AS revisions, count(DISTINCT pid) AS pages, min(ts) AS first, max(ts) AS last FROM versions GROUP BY ok"),
    ("g8_create_cluster", _members(lambda m: graph.create_cluster(m, "new", ["x", "c1", "x"])), f"{_CLUSTERS} UNION ALL SELECT 'new', unnest(['x', 'c1'])"),
    ("g8_add_members", _members(lambda m: graph.add_members(m, "k1", ["c4", "x", "c5"])), f"{_CLUSTERS} UNION (SELECT 'k1', unnest(['c4', 'x', 'c5']))"),
    ("g8_remove_members", _members(lambda m: graph.remove_members(m, "k1", ["c4", "c9"])), f"{_CLUSTERS} WHERE NOT (cluster_id = 'k1' AND entity_id IN ('c4', 'c9'))"),
    ("g8_delete_cluster", _members(lambda m: graph.delete_cluster(m, "k1")), f"{_CLUSTERS} WHERE cluster_id <> 'k1'"),
    ("g10_edge_windows", lambda spark, sf: graph.edge_windows(spark_view(spark, sf, "facts")), "SELECT rel, tStart, tEnd, array_to_string(list_sort(list(DISTINCT head || '>' || tail)), '|') AS links FROM facts WHERE NOT starts_with(tail, '\"') GROUP BY ALL"),
    ("p1_layout_predicate", _layout("predicate"), f"SELECT s, p, o, isLiteral FROM triples WHERE p IN ('<{DBO}nation>', '<{LABEL}>')"),
    ("p2_layout_type", _layout("type"), f"SELECT DISTINCT s, p, o, isLiteral FROM triples SEMI JOIN (SELECT DISTINCT s FROM triples WHERE p = '{_TYPE}' AND o IN ('{tq.COUNTRY}', '{tq.ORDER}')) x USING (s)"),
    ("p3_layout_type_predicate", _layout("type_predicate"), f"SELECT DISTINCT s, p, o, isLiteral FROM triples SEMI JOIN (SELECT DISTINCT s FROM triples WHERE p = '{_TYPE}' AND o = '{tq.CUSTOMER}') x USING (s) WHERE p IN ('<{DBO}nation>', '<{LABEL}>')"),
    ("p4_selected_predicates", _layout("all"), f"SELECT s, p, o, isLiteral FROM triples WHERE p = '<{DBO}balance>'"),
    ("p5_layout_overlap", _harness, "SELECT layout, query, n AS rows, n AS shared FROM (VALUES ('all'), ('predicate'), ('type'), ('type_predicate')) l(layout), (" + " UNION ALL ".join(f"SELECT '{n}' AS query, count(*) AS n FROM ({tq.QUERIES[[q[0] for q in tq.QUERIES].index(k)][2]}) x_{n}" for n, k in (("box", "q1_box"), ("largest", "q2_top_cities"), ("leader", "q3_leader"))) + ") q"),
    ("c8_bundle", _bundle, f"WITH {_SUB} SELECT split, part, count(*) AS rows, count(DISTINCT s) AS entities FROM parts GROUP BY ALL"),
]
