"""Queries over temporal facts and revisions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kgloom.catalog.views import DBO, RDF, SKOS, duck_view, spark_view
from kgloom.operators import serialize, statistics as st, temporal as tp
from kgloom.operators.graph import vertex_windows
from kgloom.sources import wiki
from kgloom.vocab import OPEN_END

YEARS = range(1995, 2002)
TS = 883612800  # 1998-01-01
_A = "head, rel, tail, rStart, rEnd, tStart, tEnd"
_T = "head, rel, tail"


def _on(f, view="facts"):
    return lambda spark, sf: f(spark_view(spark, sf, view))


def _at(t):
    return f"make_timestamp({t} * 1000000)"


def _stamp(t, fmt):
    return f"CASE WHEN {t} = {OPEN_END} THEN 'open' ELSE strftime({_at(f'CASE WHEN {t} < {OPEN_END} THEN {t} END')}, '{fmt}') END"


def _spread(x):
    return f"avg({x}) AS mean, quantile_disc({x}, 0.5) AS median, stddev({x}) AS std, min({x}) AS min, max({x}) AS max, quantile_disc({x}, 0.25) AS q25, quantile_disc({x}, 0.75) AS q75"


_QUANTILES = ("q25", "median", "q75")
_SPANS = re.sub(r"(quantile_disc\([^()]*\))", r"\1::DOUBLE", _spread("tEnd - tStart"))


def _doubles(df):
    """Quantiles as doubles, to whose precision they are found: open windows are longer than any double counts by one."""
    return df.withColumns({c: F.col(c).cast("double") for c in _QUANTILES})


_SEC = "%Y-%m-%d %H:%M:%S"
_DEG = lambda node, other, where: f"(SELECT year({_at('tStart')}) AS year, {node}, count({other}) AS degree FROM facts WHERE {where} GROUP BY ALL)"
_IN, _KNOWN, _OUT = _DEG("tail", "head", "starts_with(tail, 'http://')"), _DEG("tail", "head", "starts_with(tail, 'http://') AND tail IN (SELECT head FROM facts)"), _DEG("head", "tail", "true")
_SNAP = f"SELECT y AS year, {_A} FROM facts, range(1995, 2002) g(y) WHERE tStart <= epoch(make_date(y, 6, 1)) AND epoch(make_date(y, 6, 1)) <= tEnd"
_LINE = lambda t: f"CASE WHEN {t} < {OPEN_END} THEN strftime({_at(f'CASE WHEN {t} < {OPEN_END} THEN {t} END')}, '%Y-%m-%dT%H:%M:%S') ELSE '9999-12-31T23:59:59' END"
_OBJ = "CASE WHEN starts_with(tail, '\"') THEN tail ELSE '<' || tail || '>' END"
_X, _K = "http://www.w3.org/2001/XMLSchema#", serialize.TKG
_DIGEST = "md5(concat_ws('|', head, rel, tail, rStart, CAST(tStart AS VARCHAR)))"
_ENDS = lambda subject, end: [f"""{subject} || ' <{_K}{n}> "' || {v} || '"^^<{_X}{k}>{end}'""" for n, v, k in (("rStart", "rStart", "string"), ("rEnd", "rEnd", "string"), ("tStart", _LINE("tStart"), "dateTime"), ("tEnd", _LINE("tEnd"), "dateTime"))]
_ROWS = lambda parts: f"SELECT unnest([{', '.join(parts)}]) AS value FROM facts"


def _windows(ok):
    return f"""WITH v AS (SELECT pid, rid, ts, row_number() OVER w AS ord, lead(ts) OVER w AS ts2, lead(rid) OVER w AS rid2 FROM {'versions WHERE ok' if ok else 'all_versions'} WINDOW w AS (PARTITION BY pid ORDER BY ts, rid)),
vt AS (SELECT DISTINCT t.pid, head, rel, tail, ord, ts, v.rid, ts2, rid2 FROM version_triples t JOIN v ON t.pid = v.pid AND t.rid = v.rid),
i AS (SELECT *, ord - row_number() OVER (PARTITION BY pid, head, rel, tail ORDER BY ord) AS g FROM vt)
SELECT head, rel, tail, CAST(arg_min(rid, ord) AS VARCHAR) AS rStart, coalesce(CAST(arg_max(rid2, ord) FILTER (ord = m) AS VARCHAR), '{OPEN_END}') AS rEnd, arg_min(ts, ord) AS tStart, coalesce(arg_max(ts2, ord) FILTER (ord = m), {OPEN_END}) AS tEnd
FROM (SELECT *, max(ord) OVER (PARTITION BY pid, head, rel, tail, g) AS m FROM i) x GROUP BY pid, head, rel, tail, g"""


def _parts(x, monthly):
    number = (lambda t: f"(year({t}) * 12 + month({t}) - 1)") if monthly else (lambda t: f"year({t})")
    end = f"CASE WHEN tEnd < {OPEN_END} THEN tEnd END"
    time = "lpad(CAST(t // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(t % 12 + 1 AS VARCHAR), 2, '0')" if monthly else "CAST(t AS VARCHAR)"
    return f"""WITH l AS (SELECT max(greatest(tStart, coalesce({end}, tStart))) AS last FROM facts),
e AS (SELECT 'new' AS kind, {number(_at('tStart'))} AS t, {x} AS x FROM facts
 UNION SELECT 'ended', {number(_at(end))}, {x} FROM facts WHERE tEnd < {OPEN_END}
 UNION SELECT 'valid', unnest(range({number(_at('tStart'))}, {number(_at('least(tEnd, last)'))} + 1)), {x} FROM facts, l)
SELECT {time} AS time, count(*) FILTER (kind = 'new') AS new, count(*) FILTER (kind = 'ended') AS ended, count(*) FILTER (kind = 'valid') AS valid, count(*) FILTER (kind <> 'valid') AS changes FROM e WHERE t IS NOT NULL GROUP BY t"""


_STATS = f"""WITH b AS (SELECT (SELECT tStart FROM facts WHERE tStart >= 31536000 ORDER BY tStart LIMIT 1 OFFSET 1) AS f, max(tStart) AS l, count(*) AS n FROM facts),
r AS (SELECT count(*) FILTER (tStart <= f AND tEnd > f) AS a, count(*) FILTER (tStart <= l AND tEnd > l) AS z, count(*) FILTER (tStart > f) AS up, count(*) FILTER (tEnd < l) AS down, count(*) FILTER (tStart = f AND tEnd = l) AS core, any_value(n) AS n FROM facts, b),
g AS (SELECT 'yearly' AS granularity, count(DISTINCT strftime({_at('tStart')}, '%Y')) AS versions FROM facts UNION ALL SELECT 'monthly', count(DISTINCT strftime({_at('tStart')}, '%Y-%m')) FROM facts
 UNION ALL SELECT 'instant', count(DISTINCT tStart) FROM facts UNION ALL SELECT 'weekly', 1)
SELECT granularity, versions, a AS triples_first, z AS triples_last, z * 100.0::DOUBLE / a AS growth, up * 100.0::DOUBLE / n AS adds, down * 100.0::DOUBLE / n AS deletes, core AS static_core, n - core AS version_oblivious FROM r, g"""
_HOURS = f"SELECT (tEnd - tStart) // 3600 AS hours, count(*) AS count FROM facts WHERE tEnd < {OPEN_END} AND tEnd >= tStart GROUP BY ALL"
_XML = "SELECT pid, rid, ts, CASE WHEN pid % 4 = 0 THEN 14 ELSE 0 END AS ns FROM all_versions"


def _pages(spark, sf):
    """One dump fragment a page, made of the revisions."""
    v = spark_view(spark, sf, "all_versions")
    stamp = F.date_format(tp.instant(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.concat(F.lit("<revision><id>"), F.col("rid"), F.lit("</id><timestamp>"), stamp, F.lit("</timestamp><text>some {{Infobox thing |state = "), F.col("rid") % 3, F.lit(" |x={{nested}} }} text</text></revision>"))
    revs = v.groupBy("pid").agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("revs"))
    head = F.concat(F.lit("<page><title>Page "), F.col("pid"), F.lit("</title><ns>"), F.when(F.col("pid") % 4 == 0, 14).otherwise(0), F.lit("</ns><id>"), F.col("pid"), F.lit("</id>"))
    return revs.select(F.concat(head, F.col("revs"), F.lit("</page>")).alias("xml"))


def _revision_texts(spark, sf):
    s = wiki.split_pages(_pages(spark, sf))
    return s.select(
        F.regexp_extract("pagexml", "<id>(.*?)</id>", 1).cast("long").alias("pid"), F.regexp_extract("revisionxml", "<id>(.*?)</id>", 1).cast("long").alias("rid"),
        F.regexp_extract("pagexml", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("revisionxml", "(?s)<text>(.*)</text>", 1).alias("text"))


def _diff(spark, sf):
    f = spark_view(spark, sf, "facts")
    return tp.snapshot_diff(tp.snapshot(f, TS, closed=True), tp.snapshot(f, TS + 31536000, closed=True))


_CLOSED = lambda t: f"tStart <= {t} AND {t} <= tEnd"

QUERIES = [
    ("t1_windows", lambda spark, sf: tp.windows(spark_view(spark, sf, "all_versions"), spark_view(spark, sf, "version_triples")), _windows(False)),
    ("t1_windows_with_failures", lambda spark, sf: tp.windows(spark_view(spark, sf, "versions"), spark_view(spark, sf, "version_triples")), _windows(True)),
    ("f13_resources", _on(tp.resources), f"SELECT {_A} FROM facts WHERE starts_with(tail, 'http://')"),
    ("f13_resources_by_subject", _on(lambda f: tp.resources(f, known=True)), f"SELECT {_A} FROM facts SEMI JOIN (SELECT DISTINCT head AS tail FROM facts) x USING (tail) WHERE starts_with(tail, 'http://')"),
    ("f14_snapshot_half_open", _on(lambda f: tp.snapshot(f, TS)), f"SELECT {_A} FROM facts WHERE tStart <= {TS} AND {TS} < tEnd"),
    ("f15_snapshot_closed", _on(lambda f: tp.snapshot(f, TS, closed=True)), f"SELECT {_A} FROM facts WHERE {_CLOSED(TS)}"),
    ("f16_wpl", _on(tp.page_links), f"SELECT {_A} FROM facts WHERE rel = '{DBO}wikiPageWikiLink'"),
    ("f17_dbo", _on(tp.ontology), f"SELECT {_A} FROM facts WHERE (rel = '{RDF}' AND starts_with(tail, '{DBO}')) OR starts_with(rel, '{DBO}')"),
    ("f18_dbo_no_wpl", _on(lambda f: tp.ontology(f, links=False)), f"SELECT {_A} FROM facts WHERE (rel = '{RDF}' AND starts_with(tail, '{DBO}')) OR (starts_with(rel, '{DBO}') AND rel <> '{DBO}wikiPageWikiLink')"),
    ("f19_cat", _on(tp.categories), f"SELECT {_A} FROM facts WHERE tail IN ('{SKOS}Concept', '{SKOS}Concept>') OR rel IN ('{SKOS}broader', '{SKOS}subject', '{SKOS}prefLabel')"),
    ("f20_namespace", _on(lambda r: tp.in_namespaces(r, "namespace"), "revisions"), "SELECT id, pageid, timestamp, namespace FROM revisions WHERE namespace IN (0, 14)"),
    ("f23_no_literals", _on(lambda f: f.where(~F.col("tail").startswith('"'))), f"SELECT {_A} FROM facts WHERE NOT starts_with(tail, '\"')"),
    ("j9_snapshot_diff", _diff, f"""WITH a AS (SELECT DISTINCT {_T} FROM facts WHERE {_CLOSED(TS)}), b AS (SELECT DISTINCT {_T} FROM facts WHERE {_CLOSED(TS + 31536000)})
SELECT *, 1 AS diff FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x UNION ALL SELECT *, -1 FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y"""),
    ("t8_yearly_snapshots", _on(lambda f: tp.yearly_snapshots(f, YEARS)), f"SELECT CAST(year AS INTEGER) AS year, {_A} FROM ({_SNAP}) x"),
    ("t9_active_years", _on(tp.active_years), f"""SELECT {_T}, CAST(unnest(range(year({_at('tStart')}) + 1, year({_at('least(tEnd, 1767351600)')}) + 1)) AS VARCHAR) AS date FROM facts"""),
    ("a28_yearly_diff", _on(lambda f: tp.yearly_diff(f, YEARS)),
     f"""WITH s AS ({_SNAP}), d AS (SELECT DISTINCT year, {_T} FROM s), n AS (SELECT year, count(*) AS n FROM s GROUP BY year), y AS (SELECT unnest(range(1996, 2002)) AS y)
SELECT CAST(y - 1 AS INTEGER) AS prevYear, CAST(y AS INTEGER) AS currYear, coalesce((SELECT n FROM n WHERE year = y - 1), 0) AS prevSize, coalesce((SELECT n FROM n WHERE year = y), 0) AS currSize,
(SELECT count(*) FROM d a WHERE a.year = y AND NOT EXISTS (SELECT 1 FROM d b WHERE b.year = y - 1 AND b.head = a.head AND b.rel = a.rel AND b.tail = a.tail)) AS addCount,
(SELECT count(*) FROM d a WHERE a.year = y - 1 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.year = y AND b.head = a.head AND b.rel = a.rel AND b.tail = a.tail)) AS delCount FROM y"""),
    ("a1_unique_windows", _on(st.unique_windows), "SELECT count(*) AS count FROM (SELECT DISTINCT tStart, tEnd FROM facts) x"),
    ("a2_triples_per_subject", _on(st.triples_per_subject), "SELECT head, count(*) AS count FROM (SELECT DISTINCT head, rel, tail FROM facts) x GROUP BY head"),
    ("a3_revisions_per_page", _on(st.revisions_per_page), f"SELECT head, count(*) AS count FROM facts WHERE head IN (SELECT head FROM facts WHERE rel = '{DBO}wikiPageID') GROUP BY head"),
    ("a4_changes_per_predicate", _on(st.changes_per_predicate), "SELECT head, rel, count(DISTINCT tail) AS unique_changes, count(DISTINCT (rStart, rEnd)) AS all_changes FROM facts GROUP BY ALL"),
    ("a5_start_revisions", _on(st.revisions_over_time), f"SELECT {_stamp('tStart', _SEC)} AS time, count(DISTINCT rStart) AS count FROM facts GROUP BY ALL"),
    ("a6_end_revisions", _on(lambda f: st.revisions_over_time(f, end=True)), f"SELECT {_stamp('tEnd', _SEC)} AS time, count(DISTINCT rEnd) AS count FROM facts GROUP BY ALL"),
    ("a7_start_triples", _on(st.triples_over_time), f"SELECT {_stamp('tStart', '%Y')} AS year, count(*) AS count FROM (SELECT DISTINCT tStart, {_T} FROM facts) x GROUP BY ALL"),
    ("a8_end_triples", _on(lambda f: st.triples_over_time(f, end=True)), f"SELECT {_stamp('tEnd', '%Y')} AS year, count(*) AS count FROM (SELECT DISTINCT tEnd, {_T} FROM facts) x GROUP BY ALL"),
    ("a9_changes_over_time", _on(st.changes_over_time), f"SELECT {_stamp('t', _SEC)} AS time, count(*) AS count FROM (SELECT tStart AS t FROM facts UNION ALL SELECT tEnd FROM facts) x GROUP BY ALL"),
    ("a10_in_degree_frequency", _on(lambda f: st.degree_frequency(f, incoming=True)), f"SELECT year, degree, count(*) AS count FROM {_IN} x GROUP BY ALL"),
    ("a10_in_degree_frequency_by_subject", _on(lambda f: st.degree_frequency(f, incoming=True, known=True)), f"SELECT year, degree, count(*) AS count FROM {_KNOWN} x GROUP BY ALL"),
    ("a11_in_degree_distribution", _on(lambda f: st.degree_distribution(f, incoming=True)), f"SELECT year, {_spread('degree')} FROM {_IN} x GROUP BY year"),
    ("a12_out_degree_frequency", _on(lambda f: st.degree_frequency(f, incoming=False)), f"SELECT year, degree, count(*) AS count FROM {_OUT} x GROUP BY ALL"),
    ("a13_out_degree_distribution", _on(lambda f: st.degree_distribution(f, incoming=False)), f"SELECT year, {_spread('degree')} FROM {_OUT} x GROUP BY year"),
    ("a14_span_over_time", _on(lambda f: _doubles(st.activity_span(f, by_year=True))),
     f"SELECT year({_at('tStart')}) AS year, {_SPANS} FROM facts WHERE tStart <= tEnd GROUP BY ALL"),
    ("a15_span", _on(lambda f: _doubles(st.activity_span(f))), f"SELECT {_SPANS} FROM facts WHERE tStart <= tEnd"),
    ("a16_subjects_by_year", _on(lambda f: st.parts_over_time(f, "subject")), _parts("head", False)),
    ("a16_predicates_by_month", _on(lambda f: st.parts_over_time(f, "predicate", monthly=True)), _parts("rel", True)),
    ("a16_objects_by_year", _on(lambda f: st.parts_over_time(f, "object")), _parts("tail", False)),
    ("a17_snapshot_statistics", _on(lambda f: st.snapshot_statistics(f, ["yearly", "monthly", "instant", "weekly"])), _STATS),
    ("a18_summary", _on(st.summary), f"""SELECT count(*) AS triples, (SELECT count(*) FROM (SELECT DISTINCT {_T} FROM facts) x) AS distTriples, count(DISTINCT head) AS distEntities, count(DISTINCT tail) FILTER (rel = '{RDF}') AS distTypes,
count(DISTINCT rel) AS distRelations, (SELECT count(*) FROM (SELECT tStart FROM facts UNION SELECT tEnd FROM facts) y) AS distVersions FROM facts"""),
    ("a19_window_days", _on(st.window_days), f"SELECT {_stamp('tStart', '%Y-%m-%d')} AS startDay, {_stamp('tEnd', '%Y-%m-%d')} AS endDay, count(*) AS count FROM facts GROUP BY ALL"),
    ("a20_window_hours", _on(st.window_hours), _HOURS),
    ("a21_property_changes", _on(lambda f: st.property_changes(f)),
     """SELECT rel, avg(n) AS avg, min(n) AS min, max(n) AS max, quantile_disc(n, 0.25) AS q25, quantile_disc(n, 0.5) AS median, quantile_disc(n, 0.75) AS q75, CAST(sum(n) AS BIGINT) AS total_changes
FROM (SELECT head, rel, count(DISTINCT (tStart, tEnd)) - 1 AS n FROM facts WHERE NOT starts_with(rel, 'http://dbpedia.org/property') GROUP BY ALL) x GROUP BY rel"""),
    ("a22_namespace_revisions", _on(lambda r: st.namespace_counts(r, "id"), "revisions"), "SELECT namespace, count(DISTINCT id) AS count FROM revisions GROUP BY namespace"),
    ("a23_namespace_pages", _on(lambda r: st.namespace_counts(r, "pageid"), "revisions"), "SELECT namespace, count(DISTINCT pageid) AS count FROM revisions GROUP BY namespace"),
    ("a24_revisions_per_year", _on(st.revisions_per_year, "revisions"), "SELECT timestamp[1:4] AS year, namespace, count(*) AS count FROM revisions GROUP BY ALL"),
    ("a25_pages_per_year", _on(st.pages_per_year, "revisions"), "SELECT year, namespace, count(*) AS count FROM (SELECT pageid, namespace, min(timestamp[1:4]) AS year FROM revisions GROUP BY ALL) x GROUP BY ALL"),
    ("a26_out_degrees", _on(tp.out_degrees), "SELECT degree, count(*) AS heads FROM (SELECT head, count(tail) AS degree FROM facts GROUP BY head) x GROUP BY degree"),
    ("a27_yearly_out_degrees", _on(lambda f: tp.out_degrees(tp.yearly_snapshots(f, YEARS), "year")), f"SELECT CAST(year AS INTEGER) AS year, degree, count(*) AS heads FROM (SELECT year, head, count(tail) AS degree FROM ({_SNAP}) x GROUP BY ALL) y GROUP BY ALL"),
    ("a27_yearly_out_degrees_objects", _on(lambda f: tp.out_degrees(tp.yearly_snapshots(f, YEARS), "year", objects_only=True)),
     f"SELECT CAST(year AS INTEGER) AS year, degree, count(*) AS heads FROM (SELECT year, head, count(tail) AS degree FROM ({_SNAP}) x WHERE NOT starts_with(tail, '\"') GROUP BY ALL) y GROUP BY ALL"),
    ("a39_hour_bins", _on(st.hour_bins), f"""SELECT CASE WHEN hours < 1 THEN '<1h' WHEN hours < 24 THEN '1h-1d' WHEN hours < 168 THEN '1d-1w' WHEN hours < 720 THEN '1w-30d' WHEN hours < 8760 THEN '30d-1y' WHEN hours < 43800 THEN '1y-5y' ELSE '>=5y' END AS bin,
CAST(sum(count) AS BIGINT) AS count FROM ({_HOURS}) x GROUP BY bin"""),
    ("a39_iqr_fence", _on(lambda f: st.below_fence(st.window_hours(f), "count")),
     f"WITH h AS ({_HOURS}), q AS (SELECT quantile_disc(count, 0.25) AS a, quantile_disc(count, 0.75) AS b FROM h) SELECT hours, count FROM h, q WHERE count <= b + 1.5 * (b - a)"),
    ("k8_trim_tail", _on(serialize.trimmed_tails), "SELECT head, rel, CASE WHEN starts_with(tail, '\"') THEN tail ELSE left(tail, length(tail) - 1) END AS tail, rStart, rEnd, tStart, tEnd FROM facts"),
    ("k9_nquads", _on(serialize.nquads), _ROWS([f"'<' || head || '> <' || rel || '> ' || {_OBJ} || ' <{_K}' || rStart || '-' || rEnd || '> .'"] + [f"""'<{_K}' || rStart || '-' || rEnd || '> <{_K}{n}> "' || {_LINE(t)} || '"^^<{_X}dateTime> <{_K}> .'""" for n, t in (("start", "tStart"), ("end", "tEnd"))])),
    ("k10_named_graph", _on(serialize.named_graphs), _ROWS([f"'<' || head || '> <' || rel || '> ' || {_OBJ} || ' <{_K}population' || {_DIGEST} || '> .'", *_ENDS(f"'<{_K}population' || {_DIGEST} || '>'", f" <{_K}meta> .")])),
    ("k11_reification", _on(serialize.reification), _ROWS([f"'_:b' || {_DIGEST} || ' <http://www.w3.org/1999/02/22-rdf-syntax-ns#{x} .'" for x in ("type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement>", "subject> <' || head || '>", "predicate> <' || rel || '>", f"object> ' || {_OBJ} || '")] + _ENDS(f"'_:b' || {_DIGEST}", " ."))),
    ("k13_rdf_star", _on(serialize.rdf_star), _ROWS(_ENDS(f"'<< <' || head || '> <' || rel || '> ' || {_OBJ} || ' >>'", " ."))),
    ("g10_vertex_windows", _on(vertex_windows), "SELECT head, tStart, tEnd, array_to_string(list_sort(list(DISTINCT rel || '=' || tail)), '|') AS properties FROM facts WHERE starts_with(tail, '\"') GROUP BY ALL"),
    ("s6_split_pages", lambda spark, sf: wiki.split_pages(_pages(spark, sf)),
     f"""SELECT '<title>Page ' || pid || '</title><ns>' || ns || '</ns><id>' || pid || '</id>' AS pagexml, '<revision><id>' || rid || '</id><timestamp>' || strftime({_at('ts')}, '%Y-%m-%dT%H:%M:%SZ') || '</timestamp><text>some {{{{Infobox thing |state = ' || rid % 3 || ' |x={{{{nested}}}} }}}} text</text></revision>' AS revisionxml FROM ({_XML}) x"""),
    ("t7_revision_meta", lambda spark, sf: wiki.enriched(wiki.split_pages(_pages(spark, sf))), f"SELECT pid, rid, ts, CAST(ns AS INTEGER) AS ns, 'Page ' || pid AS title FROM ({_XML}) x"),
    ("t10_templates", lambda spark, sf: wiki.with_templates(_revision_texts(spark, sf)).select("pid", "rid", F.explode("templates").alias("t")).select("pid", "rid", "t.name", "t.hash", "t.content"),
     "SELECT pid, rid, 'Infobox thing' AS name, to_base64(unhex(md5(content))) AS hash, content FROM (SELECT pid, rid, '{{Infobox thing |state = ' || rid % 3 || ' |x={{nested}} }}' AS content FROM all_versions) x"),
    ("t3_field_triples", lambda spark, sf: wiki.field_triples(_revision_texts(spark, sf), "http://ex.org/"),
     "SELECT pid, rid, 'http://ex.org/Page_' || pid AS head, 'http://ex.org/property/state' AS rel, '\"' || rid % 3 || '\"' AS tail FROM all_versions"),
]
