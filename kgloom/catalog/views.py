"""Inputs of the queries: the driver's tables as triples, facts, revisions, entities, pairs and edges.

Each view is one SQL text that Spark and DuckDB both run; ``EPOCH(x)`` stands
for seconds since 1970, ``STRING`` is a type of both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.plans.durable import by_key

RDF, DBO, DBP, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://dbpedia.org/ontology/", "http://dbpedia.org/property/", "http://www.w3.org/2004/02/skos/core#"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"
_C, _O, _N, _R, _S = ("'<http://ex.org/{}/' || CAST({} AS STRING) || '>'".format(a, b) for a, b in (("c", "c_custkey"), ("o", "o_orderkey"), ("n", "n_nationkey"), ("r", "n_regionkey"), ("s", "s_suppkey")))
_CN, _SN, _OC = "'<http://ex.org/n/' || CAST(c_nationkey AS STRING) || '>'", "'<http://ex.org/n/' || CAST(s_nationkey AS STRING) || '>'", "'<http://ex.org/c/' || CAST(o_custkey AS STRING) || '>'"


def _t(s, p, o, table, literal=False, where="true"):
    return table, where, {"s": s, "p": f"'{p}'", "o": o, "isLiteral": str(literal).lower()}


#: (table, condition, columns) of each kind of row.
PARTS = {
    "triples": [
        _t(_C, f"<{RDF}>", f"'<{DBO}Customer>'", "customer", where="c_custkey % 7 <> 0"),
        _t(_C, "a", f"'<{DBO}Agent>'", "customer", where="c_custkey % 5 = 0"),
        _t(_C, f"<{RDF}>", "'<http://ex.org/class/' || c_mktsegment || '>'", "customer", where="c_custkey % 3 = 0"),
        _t(_C, f"<{LABEL}>", "'\"' || c_name || '\"@en'", "customer", True),
        _t(_C, f"<{DBP}segment>", "'\"' || c_mktsegment || '\"'", "customer", True),
        _t(_C, f"<{DBO}balance>", f"'\"' || CAST(c_acctbal AS STRING) || '\"^^<{XSD}double>'", "customer", True),
        _t(_C, f"<{DBO}nation>", _CN, "customer"),
        _t(_O, f"<{RDF}>", f"'<{DBO}Order>'", "orders"),
        _t(_O, f"<{DBO}placedBy>", _OC, "orders"),
        _t(_O, f"<{DBO}abstract>", "'\"order of ' || o_orderpriority || '\"@en'", "orders", True),
        _t(_O, f"<{DBP}status>", "'\"' || o_orderstatus || '\"'", "orders", True),
        _t(_O, "<http://ex.org/priority>", "'<http://ex.org/prio/' || substr(o_orderpriority, 1, 1) || '>'", "orders"),
        _t(_N, f"<{RDF}>", f"'<{DBO}Place>'", "nation"),
        _t(_N, f"<{RDF}>", f"'<{DBO}Country>'", "nation"),
        _t(_N, f"<{LABEL}>", "'\"' || n_name || '\"@en'", "nation", True),
        _t(_N, f"<{DBO}region>", _R, "nation"),
        _t(_N, f"<{DBO}region>", _R, "nation", where="n_nationkey % 2 = 0"),
        _t(_S, f"<{RDF}>", f"'<{DBO}Agent>'", "supplier", where="s_suppkey % 3 <> 0"),
        _t(_S, f"<{LABEL}>", "'\"' || s_name || '\"@de'", "supplier", True),
        _t(_S, f"<{DBO}nation>", _SN, "supplier"),
        _t(_S, f"<{DBO}partner>", "'<http://ex.org/c/' || CAST(s_suppkey * 7 AS STRING) || '>'", "supplier"),
    ]
}

_ORDERS = """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, EPOCH(o_orderdate) AS t, o_orderpriority AS pr,
 lead(EPOCH(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t2,
 lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k2 FROM orders"""


def _f(rel, tail, end, rend, where="true"):
    columns = {"head": "'http://ex.org/c/' || CAST(c AS STRING)", "rel": f"'{rel}'", "tail": tail, "rStart": "CAST(k AS STRING)", "rEnd": rend, "tStart": "t", "tEnd": end}
    return f"({_ORDERS}) x", where, columns


_NEXT, _NEXTR = "coalesce(t2, 9223372036854775807)", "coalesce(CAST(k2 AS STRING), '9223372036854775807')"
PARTS["facts"] = [
    _f(f"{DBO}status", "'\"' || st || '\"'", _NEXT, _NEXTR),
    _f(f"{DBO}wikiPageWikiLink", "'http://ex.org/c/' || CAST(k % 97 AS STRING)", "t + 3600 * (k % 9000)", "CAST(k + 1 AS STRING)"),
    _f(RDF, f"'{DBO}Class' || substr(pr, 1, 1)", _NEXT, _NEXTR),
    _f(f"{DBO}wikiPageID", "'\"' || CAST(c AS STRING) || '\"'", "9223372036854775807", "'9223372036854775807'", "c % 3 = 0"),
    _f(f"{DBP}note", "'\"' || pr || '\"@en'", _NEXT, _NEXTR),
    _f(f"{SKOS}broader", "'https://ex.org/k/' || CAST(c % 11 AS STRING)", _NEXT, _NEXTR, "k % 4 = 0"),
    _f(RDF, f"'{SKOS}Concept>'", _NEXT, _NEXTR, "c % 10 = 0"),
]


def _union(parts):
    """One SELECT a part, for DuckDB."""
    return "\nUNION ALL ".join(f"SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table} WHERE {where}" for table, where, columns in parts)


def _inline(parts):
    """One SELECT a table, which makes all of its rows in one pass, for Spark."""
    out = []
    for table in dict.fromkeys(t for t, _, _ in parts):
        rows = [f"CASE WHEN {w} THEN named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in c.items())}) END" for t, w, c in parts if t == table]
        out.append(f"SELECT inline(filter(array({', '.join(rows)}), r -> r IS NOT NULL)) FROM {table}")
    return "\nUNION ALL ".join(out)


VIEWS = {
    "triples": _union(PARTS["triples"]),
    "facts": _union(PARTS["facts"]),
    "revisions": "SELECT o_orderkey AS id, o_custkey AS pageid, CAST(o_orderdate AS STRING) AS timestamp, CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 14 ELSE 3 END AS namespace FROM orders "
    "UNION ALL SELECT o_orderkey, o_custkey, CAST(o_orderdate AS STRING), 0 FROM orders WHERE o_custkey % 5 = 0",
    "versions": "SELECT o_custkey AS pid, o_orderkey AS rid, EPOCH(o_orderdate) AS ts, o_orderkey % 11 <> 0 AS ok FROM orders",
    "all_versions": "SELECT o_custkey AS pid, o_orderkey AS rid, EPOCH(o_orderdate) AS ts, true AS ok FROM orders",
    "version_triples": "SELECT o_custkey AS pid, o_orderkey AS rid, 'http://ex.org/c/' || CAST(o_custkey AS STRING) AS head, 'status' AS rel, '\"' || o_orderstatus || '\"' AS tail FROM orders WHERE o_orderkey % 13 <> 0 "
    "UNION ALL SELECT o_custkey, o_orderkey, 'http://ex.org/c/' || CAST(o_custkey AS STRING), 'priority', '\"' || substr(o_orderpriority, 1, 1) || '\"' FROM orders WHERE o_orderkey % 13 <> 0",
    # entities in long form: (identifier, source, k, v)
    "properties": "SELECT 'c' || CAST(c_custkey AS STRING) AS identifier, 'www.shop' || CAST(c_nationkey % 4 AS STRING) || '.com' AS source, 'name' AS k, c_name AS v FROM customer WHERE c_custkey % 9 <> 0 "
    "UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'www.shop' || CAST(c_nationkey % 4 AS STRING) || '.com', '<market segment>', CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END FROM customer WHERE c_custkey % 4 <> 0 "
    "UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'www.shop' || CAST(c_nationkey % 4 AS STRING) || '.com', 'balance', CAST(c_acctbal AS STRING) FROM customer WHERE c_custkey % 6 <> 0 "
    "UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'www.shop' || CAST(c_nationkey % 4 AS STRING) || '.com', 'recId', CAST(c_custkey // 3 AS STRING) FROM customer WHERE c_custkey % 6 <> 0",
    "entity_ids": "SELECT 'c' || CAST(c_custkey AS STRING) AS identifier, 'www.shop' || CAST(c_nationkey % 4 AS STRING) || '.com' AS source FROM customer",
    "pairs": "SELECT CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split, 'c' || CAST(c_custkey AS STRING) AS id1, 'c' || CAST(c_custkey * 2 AS STRING) AS id2, "
    "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_match, CAST(c_nationkey AS DOUBLE) / 100 AS confidence FROM customer "
    "UNION ALL SELECT 'train', 'c' || CAST(c_custkey AS STRING), 'c' || CAST(c_custkey * 2 AS STRING), c_custkey % 2 = 0, 0.99 FROM customer WHERE c_custkey % 4 = 0",
    "edges": "SELECT 'c' || CAST(a.c_custkey AS STRING) AS src, 'c' || CAST(b.c_custkey AS STRING) AS dst, CAST((a.c_nationkey * 7 + b.c_nationkey * 3) % 10 AS DOUBLE) / 10 AS sim FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_mktsegment = b.c_mktsegment "
    "UNION ALL SELECT 'c' || CAST(b.c_custkey AS STRING), 'c' || CAST(a.c_custkey AS STRING), CAST((a.c_nationkey * 7 + b.c_nationkey) % 10 AS DOUBLE) / 10 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 2 AND a.c_nationkey % 5 = b.c_nationkey % 5 "
    "UNION ALL SELECT 'c' || CAST(a.c_custkey AS STRING), 'c' || CAST(a.c_custkey + 1 AS STRING), 0.5 FROM customer a WHERE a.c_custkey % 6 = 0",
    "clusters": "SELECT 'k' || CAST(c_custkey // 4 AS STRING) AS cluster_id, 'c' || CAST(c_custkey AS STRING) AS entity_id, CASE WHEN c_custkey % 12 = 0 THEN 'f' || CAST(c_custkey AS STRING) END AS fused_id, c_acctbal AS balance, c_name AS name, c_nationkey AS nation FROM customer",
    "parents": "SELECT DISTINCT p_brand || p_type AS class, p_type AS parent FROM part UNION SELECT DISTINCT p_type, substr(p_type, 1, 3) FROM part UNION SELECT DISTINCT p_name, p_brand || p_type FROM part UNION SELECT DISTINCT substr(p_type, 1, 3), p_type FROM part WHERE p_type = 'ECONOMY'",
    "anchors": "SELECT DISTINCT CASE WHEN p_type < 'M' THEN 'Goods' ELSE 'Works' END AS domain, p_type AS class FROM part UNION SELECT DISTINCT 'Brands', p_brand || p_type FROM part WHERE p_brand = 'Brand#2'",
    "class_names": "SELECT DISTINCT p_name AS class, p_name AS name FROM part UNION SELECT DISTINCT p_name, p_type FROM part",
}
KEYWORDS = [("Goods", "ring"), ("Goods", "widget"), ("Works", "economy"), ("Works", "small"), ("Brands", "standa"), ("Brands", "widget"), ("Goods", "econom"), ("Brands", "promo")]


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"EPOCH\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", _inline(PARTS[name]) if name in PARTS else VIEWS[name]).replace(" // ", " div ")
    used = set(re.findall(r"\b(customer|orders|nation|supplier|part)\b", sql))
    sql = re.sub(r"\b(FROM|JOIN) (customer|orders|nation|supplier|part)\b", r"\1 {\2}", sql)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if f"{{{t}}}" in sql}
    if name == "facts":
        # an order makes several facts after its window, so a task takes few of them
        tables["orders"] = by_key(tables["orders"], "o_custkey")
    return spark.sql(sql, **tables)


def duck_view(name: str) -> str:
    return re.sub(r"EPOCH\((\w+)\)", r"CAST(epoch(\1) AS BIGINT)", VIEWS[name])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form as rows with a map; entities without properties have an empty one."""
    each = spark_view(spark, sf_dir, "properties").groupBy("identifier").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))
    empty = F.create_map().cast("map<string,string>")
    return spark_view(spark, sf_dir, "entity_ids").join(each, "identifier", "left").withColumn("properties", F.coalesce("properties", empty)).select("identifier", "source", "properties")
