"""Queries over triples: parsing, filters, joins, sampling, the schema graph and the layout study."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog.views import DBO, DBP, LABEL, RDF, SKOS, spark_view
from kgloom.operators import layout, sampling, serialize, triples
from kgloom.operators.schema_graph import schema_graph
from kgloom.sources import text

CUSTOMER, AGENT, PLACE, COUNTRY, ORDER = (f"<{DBO}{x}>" for x in ("Customer", "Agent", "Place", "Country", "Order"))
TYPE = f"<{RDF}>"
_ALL = "s, p, o, isLiteral"
_IS_TYPE = f"p IN ('{TYPE}', 'a')"


def _on(f):
    return lambda spark, sf: f(spark_view(spark, sf, "triples"))


def _lines(spark, sf):
    """The triples as text, among lines that aren't any."""
    t = serialize.ntriples(spark_view(spark, sf, "triples"))
    odd = spark.createDataFrame([(x,) for x in ODD], "value string")
    return t.union(odd)


ODD = ["# comment .", "", "   ", "<a> <b> .", "a b.", "<a>\t<b>\t\"x y\"@en.", "<a> <b> <c> <g> .", "<a> <b> <c>", "  <s> <p> \"it ends. \" .  "]


def _order(seed, *ids):
    return f"md5('{seed}|' || " + " || '|' || ".join(ids) + ")"


def _selected(seeds, related, seed, directed):
    back = "" if directed else " UNION SELECT o, s FROM triples WHERE NOT isLiteral AND s <> o"
    return f"""WITH seeds AS ({seeds}),
near AS (SELECT s AS e, o AS n FROM triples WHERE NOT isLiteral AND s <> o{back}),
ranked AS (SELECT DISTINCT e, n, row_number() OVER (PARTITION BY e ORDER BY {_order(seed, 'e', 'n')}, n) AS r FROM (SELECT DISTINCT e, n FROM near WHERE e IN (SELECT s FROM seeds)) x)
SELECT {_ALL} FROM triples WHERE s IN (SELECT s FROM seeds UNION SELECT n FROM ranked WHERE r <= {related})"""


_TYPED = f"SELECT DISTINCT s FROM triples WHERE p = '{TYPE}' AND o IN"
_SCHEMA = f"""WITH types AS (SELECT DISTINCT s AS e, o AS type FROM triples WHERE {_IS_TYPE})
SELECT coalesce(a.type, 'Untyped') AS SourceType, p AS Relation, CASE WHEN isLiteral THEN 'Literal' ELSE coalesce(b.type, 'Untyped') END AS TargetType, count(*) AS Count
FROM triples t LEFT JOIN types a ON t.s = a.e LEFT JOIN types b ON t.o = b.e AND NOT t.isLiteral
WHERE p = '<{LABEL}>' OR starts_with(p, '<{DBO}') GROUP BY ALL"""
_EN = f"""labels AS (SELECT s, min(regexp_extract(o, '^"(.*)"@en$', 1)) AS label FROM triples WHERE p = '<{LABEL}>' AND o LIKE '%"@en' GROUP BY s)"""
_NUM = """try_cast(regexp_extract(o, '^"([^"]*)"', 1) AS DOUBLE)"""
_SHADE = lambda c: f"CASE WHEN starts_with({c}, '<http://ex.org/c/') THEN '<http://shade.org/' || md5({c}) || '>' ELSE {c} END"


#: Rarest type first, as the operator takes them.
_TARGETS = [(COUNTRY, 5), (CUSTOMER, 300), (ORDER, 40)]


def _targets(targets, related, seed):
    """One round a type: entities that are missing, then their neighbours."""
    out = f"""WITH near AS (SELECT s AS e, o AS n FROM triples WHERE NOT isLiteral AND s <> o UNION SELECT o, s FROM triples WHERE NOT isLiteral AND s <> o),
got_ AS (SELECT '' AS s WHERE false)"""
    before = "got_"
    for i, (kind, n) in enumerate(targets):
        out += f""",
own{i} AS (SELECT DISTINCT s FROM triples WHERE {_IS_TYPE} AND o = '{kind}'),
new{i} AS (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY {_order(seed + i, 's')}, s) AS r FROM own{i} ANTI JOIN {before} USING (s)) x WHERE r <= {n} - (SELECT count(*) FROM own{i} SEMI JOIN {before} USING (s))),
got{i} AS (SELECT s FROM {before} UNION SELECT s FROM new{i} UNION
 SELECT n FROM (SELECT e, n, row_number() OVER (PARTITION BY e ORDER BY {_order(seed + 1000 + i, 'e', 'n')}, n) AS r FROM near SEMI JOIN (SELECT s AS e FROM new{i}) y USING (e)) x WHERE r <= {related})"""
        before = f"got{i}"
    return out + f" SELECT {_ALL} FROM triples SEMI JOIN {before} USING (s)"


def _nested(depth):
    """The nested objects, one table a level."""
    out = ""
    for k in range(depth + 1):
        value = "to_json(f.o)" if not k else f"coalesce(n{k - 1}.json, to_json(f.o))"
        more = f" LEFT JOIN n{k - 1} ON n{k - 1}.s = f.o" if k else ""
        out += f"""{', ' if k else ''}n{k} AS (SELECT s, '{{"@id":' || to_json(s) || ',' || string_agg(to_json(p) || ':[' || vs || ']', ',' ORDER BY p) || '}}' AS json
FROM (SELECT f.s, f.p, string_agg({value}, ',' ORDER BY f.o) AS vs FROM d f{more} GROUP BY f.s, f.p) x GROUP BY s)"""
    return f"WITH d AS (SELECT DISTINCT s, p, o FROM triples), {out} SELECT s, json FROM n{depth}"


_NESTED = _nested(2)
_MOVED = lambda c: f"CASE WHEN starts_with({c}, '<{DBO}') THEN '<http://kg.org/ontology/' || substr({c}, {len(DBO) + 2}) ELSE {c} END AS {c}"

QUERIES = [
    ("s1_parse_nt", lambda spark, sf: text.parse_ntriples(_lines(spark, sf)),
     f"""WITH lines AS (SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM triples UNION ALL SELECT unnest([{', '.join("'" + x.replace("'", "''") + "'" for x in ODD)}])),
parts AS (SELECT regexp_split_to_array(regexp_replace(regexp_replace(value, '^\\s+', ''), '\\s+$', ''), '\\s+') AS a, regexp_replace(regexp_replace(value, '^\\s+', ''), '\\s+$', '') AS l FROM lines),
cut AS (SELECT a[1] AS s, a[2] AS p, regexp_replace(regexp_extract(l, '^\\S+\\s+\\S+\\s+(.*)$', 1), '\\s*\\.\\s*$', '') AS o FROM parts WHERE l <> '' AND NOT starts_with(l, '#') AND l LIKE '%.' AND len(a) >= 3)
SELECT s, p, o, starts_with(o, '"') AS isLiteral FROM cut WHERE o <> ''"""),
    ("k1_serialize_nt", _on(serialize.ntriples), "SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM triples"),
    ("f1_type_predicate", _on(lambda t: t.where(triples.is_type())), f"SELECT {_ALL} FROM triples WHERE {_IS_TYPE}"),
    ("f2_subject_type", _on(lambda t: triples.with_types(t, [CUSTOMER])), f"SELECT {_ALL} FROM triples SEMI JOIN ({_TYPED} ('{CUSTOMER}')) x USING (s)"),
    ("f3_subject_types", _on(lambda t: triples.with_types(t, [PLACE, COUNTRY, AGENT])), f"SELECT {_ALL} FROM triples SEMI JOIN ({_TYPED} ('{PLACE}', '{COUNTRY}', '{AGENT}')) x USING (s)"),
    ("f4_chained_types", _on(lambda t: triples.with_all_types(t, [PLACE, COUNTRY])), f"SELECT {_ALL} FROM triples SEMI JOIN ({_TYPED} ('{PLACE}')) x USING (s) SEMI JOIN ({_TYPED} ('{COUNTRY}')) y USING (s)"),
    ("f5_clean_types", _on(lambda t: triples.only_types(t, [CUSTOMER, PLACE])), f"SELECT {_ALL} FROM triples WHERE p <> '{TYPE}' OR o IN ('{CUSTOMER}', '{PLACE}')"),
    ("f6_connected_objects", _on(triples.connected_objects), f"SELECT {_ALL} FROM triples WHERE isLiteral OR {_IS_TYPE} UNION ALL SELECT {_ALL} FROM triples SEMI JOIN (SELECT DISTINCT s AS o FROM triples) x USING (o) WHERE NOT (isLiteral OR {_IS_TYPE})"),
    ("f7_class_subgraph", _on(lambda t: triples.class_subgraph(t, [COUNTRY, AGENT, f" {CUSTOMER} "])),
     f"""WITH own AS (SELECT DISTINCT s FROM triples WHERE {_IS_TYPE} AND o IN ('{COUNTRY}', '{AGENT}', '{CUSTOMER}'))
SELECT DISTINCT {_ALL} FROM triples WHERE s IN (SELECT s FROM own) AND (isLiteral OR o IN (SELECT s FROM own) OR ({_IS_TYPE} AND o IN ('{COUNTRY}', '{AGENT}', '{CUSTOMER}')))"""),
    ("f8_predicate", _on(lambda t: triples.with_predicate(t, f"<{DBO}nation>")), f"SELECT {_ALL} FROM triples WHERE p = '<{DBO}nation>'"),
    ("f9_property_filter", _on(triples.with_properties), f"SELECT {_ALL} FROM triples WHERE p = '<{LABEL}>' OR starts_with(p, '<{DBO}')"),
    ("f9_property_filter_prefix", _on(lambda t: triples.with_properties(t, ["<http://ex.org/*", f"<{DBP}status>", " "])), f"SELECT {_ALL} FROM triples WHERE p = '<{DBP}status>' OR starts_with(p, '<http://ex.org/')"),
    ("f24_namespace_split", _on(triples.by_namespace),
     f"""SELECT {_ALL}, CASE WHEN p = '<{DBO}abstract>' THEN 'abstract' WHEN starts_with(p, '<{DBO}') THEN 'ontology' WHEN starts_with(p, '<{DBP}') THEN 'property' ELSE 'other' END AS namespace FROM triples"""),
    ("x1_triple_join", _on(lambda t: triples.triple_join(t.where(F.col("p") == f"<{DBO}placedBy>"), t.where(F.col("p") == f"<{DBO}nation>"))),
     f"SELECT a.s, a.p, a.o, b.s AS s2, b.p AS p2, b.o AS o2 FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = '<{DBO}placedBy>' AND b.p = '<{DBO}nation>'"),
    ("x2_pattern_filter", _on(lambda t: triples.matching(t, p=f"<{DBO}nation>", o="<http://ex.org/n/3>")), f"SELECT {_ALL} FROM triples WHERE p = '<{DBO}nation>' AND o = '<http://ex.org/n/3>'"),
    ("x3_project", _on(lambda t: triples.project(t, ["p", "o"])), "SELECT p, o FROM triples"),
    ("x4_triple_aggregate", _on(triples.aggregate), "SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM triples GROUP BY p"),
    ("a29_schema_graph", _on(schema_graph), _SCHEMA),
    ("a30_type_frequency", _on(triples.type_frequency), f"SELECT o AS type, count(DISTINCT s) AS entities FROM triples WHERE {_IS_TYPE} GROUP BY o"),
    ("j14_typed_triples", _on(layout.typed_triples), f"SELECT t.*, x.type FROM triples t JOIN (SELECT DISTINCT s, o AS type FROM triples WHERE p = '{TYPE}') x ON t.s = x.s"),
    ("l1_sample_global", _on(lambda t: sampling.sample_global(t, 200, related=3)), _selected(f"SELECT s FROM (SELECT DISTINCT s FROM triples) x ORDER BY {_order(42, 's')}, s LIMIT 200", 3, 42, False)),
    ("l2_sample_type_targets", _on(lambda t: sampling.sample_type_targets(t, dict(_TARGETS), related=2)), _targets(_TARGETS, 2, 42)),
    ("l3_sample_all_types", _on(lambda t: sampling.sample_all_types(t, 20, related=2)),
     _selected(f"SELECT DISTINCT s FROM (SELECT s, row_number() OVER (PARTITION BY o ORDER BY {_order(42, 's')}, s) AS r FROM (SELECT DISTINCT s, o FROM triples WHERE {_IS_TYPE}) y) x WHERE r <= 20", 2, 42, True)),
    ("u6_overlap_subsets", _on(lambda t: sampling.overlapping_subsets(t, "s", k=4, size=100, overlap=0.1)),
     f"""WITH r AS (SELECT s, row_number() OVER (ORDER BY {_order(42, 's')}, s) - 1 AS r FROM (SELECT DISTINCT s FROM triples) x)
SELECT CAST(k AS INTEGER) AS subset, s FROM r, range(4) g(k) WHERE r < 10 UNION ALL SELECT CAST((r - 10) // 90 AS INTEGER), s FROM r WHERE r >= 10 AND r < 370"""),
    ("c7_shade_namespace", _on(lambda t: triples.shade_namespace(t, "http://ex.org/c/", "http://shade.org/")), f"SELECT {_SHADE('s')} AS s, p, {_SHADE('o')} AS o, isLiteral FROM triples"),
    ("c9_mapped_properties", _on(lambda t: triples.mapped_properties(t, [(f"<{LABEL}>", "<name>", "LITERAL"), (f"<{DBO}nation>", "<in>", "OBJECT"), (f"<{DBO}region>", "<in>", "LITERAL")])),
     f"SELECT s, CASE WHEN p = '<{LABEL}>' THEN '<name>' ELSE '<in>' END AS p, o, isLiteral FROM triples WHERE (p = '<{LABEL}>' AND isLiteral) OR (p = '<{DBO}nation>' AND NOT isLiteral) OR (p = '<{DBO}region>' AND isLiteral)"),
    ("c10_entity_json", _on(triples.one_level),
     """SELECT s, '{' || string_agg(to_json(p) || ':[' || os || ']', ',' ORDER BY p) || '}' AS json FROM (SELECT s, p, string_agg(to_json(o), ',' ORDER BY o) AS os FROM (SELECT DISTINCT s, p, o FROM triples) x GROUP BY s, p) y GROUP BY s"""),
    ("c10_nested_json", _on(lambda t: triples.nested(t, 2)), _NESTED),
    ("c7_namespace_replaced", _on(lambda t: triples.replace_namespace(t, DBO, "http://kg.org/ontology/")), f"SELECT {', '.join(_MOVED(c) for c in 'spo')}, isLiteral FROM triples"),
    ("c7_alt_labels", _on(triples.with_alt_labels), f"SELECT {_ALL} FROM triples UNION ALL SELECT s, '<{SKOS}altLabel>', o, isLiteral FROM triples WHERE p = '<{LABEL}>'"),
    ("c12_coverage_sample", _on(lambda t: sampling.sample_coverage(t, 15, related=2)),
     _selected(f"SELECT DISTINCT s FROM (SELECT s, row_number() OVER (PARTITION BY p ORDER BY {_order(42, 's')}, s) AS r FROM (SELECT DISTINCT s, p FROM triples) y) x WHERE r <= 15", 2, 42, True)),
    ("c11_related_by_property", _on(lambda t: triples.related_by_property(t, {f"<{DBO}placedBy>": "Person", f"<{DBO}nation>": "Place"})),
     f"SELECT DISTINCT s AS entity, CASE p WHEN '<{DBO}placedBy>' THEN 'Person' ELSE 'Place' END AS kind, o AS related FROM triples WHERE p IN ('<{DBO}placedBy>', '<{DBO}nation>') AND NOT isLiteral"),
    ("c12_untyped_removed", _on(triples.untyped_removed), f"SELECT {_ALL} FROM triples SEMI JOIN (SELECT DISTINCT s FROM triples WHERE {_IS_TYPE}) x USING (s)"),
    ("c12_types_from_relations", _on(lambda t: triples.types_from_relations(t, {f"<{DBO}placedBy>": ORDER}, {f"<{DBO}placedBy>": CUSTOMER, f"<{DBO}nation>": PLACE})),
     f"""SELECT s, '{ORDER}' AS type FROM triples WHERE p = '<{DBO}placedBy>' UNION SELECT o, CASE p WHEN '<{DBO}nation>' THEN '{PLACE}' ELSE '{CUSTOMER}' END FROM triples WHERE p IN ('<{DBO}placedBy>', '<{DBO}nation>')"""),
    ("q1_box", _on(lambda t: layout.in_box(t, CUSTOMER, (0, 5000), (100, 9000), f"<{DBO}balance>", f"<{DBO}balance>")),
     f"""WITH {_EN}, v AS (SELECT s, min({_NUM}) AS x FROM triples WHERE p = '<{DBO}balance>' GROUP BY s)
SELECT s, label, x AS lat, x AS long FROM (SELECT DISTINCT s FROM triples WHERE p = '{TYPE}' AND o = '{CUSTOMER}') c JOIN v USING (s) JOIN labels USING (s) WHERE x BETWEEN 100 AND 5000 ORDER BY label, s LIMIT 10"""),
    ("q2_top_cities", _on(lambda t: layout.largest(t, CUSTOMER, f"<{DBO}balance>")),
     f"""WITH {_EN}, v AS (SELECT s, max({_NUM}) AS value FROM triples WHERE p = '<{DBO}balance>' GROUP BY s)
SELECT s, label, value FROM (SELECT DISTINCT s FROM triples WHERE p = '{TYPE}' AND o = '{CUSTOMER}') c JOIN v USING (s) JOIN labels USING (s) ORDER BY value DESC, s LIMIT 10"""),
    ("q3_leader", _on(lambda t: layout.led_to(t, CUSTOMER, "Customer#000000001", f"<{DBO}nation>")),
     f"""WITH {_EN} SELECT a.s, t.o AS target, b.label AS target_label FROM (SELECT DISTINCT s FROM triples WHERE p = '{TYPE}' AND o = '{CUSTOMER}') c JOIN labels a USING (s)
JOIN (SELECT DISTINCT s, o FROM triples WHERE p = '<{DBO}nation>') t ON t.s = a.s JOIN labels b ON b.s = t.o WHERE a.label = 'Customer#000000001'"""),
]
