"""Page dumps: revisions, their metadata and their templates."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, ns int, id bigint, revision array<struct<id:bigint,timestamp:string,text:string>>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of dump files; splits within a file are found by Spark's XML source."""
    return spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)


def revisions(pages: DataFrame) -> DataFrame:
    """(pid, rid, ts, ns, title, text) of every revision; ts in epoch seconds."""
    rows = pages.select("title", "ns", F.col("id").alias("pid"), F.explode("revision").alias("r"))
    return rows.select("pid", F.col("r.id").alias("rid"), iso_epoch("r.timestamp").alias("ts"), "ns", "title", F.col("r.text").alias("text"))


def iso_epoch(column: str):
    """``2024-01-31T12:00:00Z`` as epoch seconds, in any session zone."""
    from kgloom.functions.literals import epoch

    return epoch(F.to_timestamp_ntz(F.substring(column, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def split_pages(pages: DataFrame, column: str = "xml") -> DataFrame:
    """(pagexml, revisionxml) of each revision: the page's head before its first revision, and the revision."""
    x = F.col(column)
    head = F.regexp_extract(x, r"(?s)^.*?<page>(.*?)(?:<revision>.*)?</page>", 1)
    parts = F.regexp_extract_all(x, F.lit(r"(?s)<revision>.*?</revision>"), F.lit(0))
    return pages.select(F.trim(head).alias("pagexml"), F.explode(parts).alias("revisionxml"))


def enriched(splits: DataFrame) -> DataFrame:
    """(pid, rid, ts, ns, title) of page and revision fragments; a missing namespace is null."""
    get = lambda c, tag: F.nullif(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(""))
    rows = splits.select(
        get("pagexml", "id").try_cast("bigint").alias("pid"), get("revisionxml", "id").try_cast("bigint").alias("rid"),
        get("revisionxml", "timestamp").alias("t"), get("pagexml", "ns").try_cast("int").alias("ns"), get("pagexml", "title").alias("title"),
    )
    return rows.select("pid", "rid", iso_epoch("t").alias("ts"), "ns", "title")


def flat_json(splits: DataFrame) -> DataFrame:
    return splits.select(F.to_json(F.struct("pagexml", "revisionxml")).alias("value"))


def located(df: DataFrame, page: str = "pid", revision: str = "rid", partitions: int | None = None) -> DataFrame:
    """Rows with a page's revisions together and in order."""
    placed = df.repartition(partitions, page) if partitions else df.repartition(page)
    return placed.sortWithinPartitions(page, revision)


_BRACES = re.compile(r"\{\{|\}\}")


def templates_in(text: str, prefix: str) -> list[tuple[str, str, str]]:
    """(name, base64 MD5, content) of the templates whose name starts with the prefix; unbalanced ones are left out.

    One pass matches all braces, so nesting costs no second look.
    """
    opened, ends = [], {}
    for m in _BRACES.finditer(text):
        if m.group() == "{{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    out = []
    for m in re.finditer(r"\{\{\s*(" + re.escape(prefix) + r"[^|{}]*)", text, re.I):
        if m.start() in ends:
            body = text[m.start() : ends[m.start()]]
            out.append((m.group(1).strip(), base64.b64encode(hashlib.md5(body.encode()).digest()).decode(), body))
    return out


_TEMPLATES = "array<struct<name:string,hash:string,content:string>>"
_KIND = pa.list_(pa.struct([("name", pa.string()), ("hash", pa.string()), ("content", pa.string())]))


def with_templates(revisions_: DataFrame, prefix: str = "Infobox", column: str = "text") -> DataFrame:
    """Revisions with at least one such template, and ``templates``."""

    @F.arrow_udf(_TEMPLATES)
    def scan(text: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("name", "hash", "content"), t)) for t in templates_in(x or "", prefix)] for x in text.to_pylist()], _KIND)

    # only texts with an opening that fits go to Python
    maybe = revisions_.where(F.col(column).rlike(r"(?i)\{\{\s*\Q" + prefix + r"\E"))
    return maybe.withColumn("templates", scan(column)).where(F.size("templates") > 0)


def field_triples(revisions_: DataFrame, base: str, prefix: str = "Infobox") -> DataFrame:
    """(pid, rid, head, rel, tail) from the templates' ``name = value`` fields: a local stand-in for an extraction service."""
    rows = with_templates(revisions_, prefix).select("pid", "rid", "title", F.explode("templates.content").alias("c"))
    fields = F.regexp_extract_all("c", F.lit(r"\|\s*(\w+)\s*=\s*([^|{}\n]*)"), F.lit(0))
    rows = rows.select("pid", "rid", "title", F.explode(fields).alias("f"))
    key, value = F.regexp_extract("f", r"\|\s*(\w+)", 1), F.trim(F.regexp_extract("f", r"=\s*([^|{}\n]*)", 1))
    rows = rows.select("pid", "rid", F.concat(F.lit(base), F.replace("title", F.lit(" "), F.lit("_"))).alias("head"), F.concat(F.lit(base + "property/"), key).alias("rel"), value.alias("v"))
    return rows.where("v <> ''").select("pid", "rid", "head", "rel", F.concat(F.lit('"'), F.col("v"), F.lit('"')).alias("tail"))


def expand_endpoints(patterns: list[str]) -> list[str]:
    """``host:9501-9504/path`` as one address a port; others as they are."""
    out = []
    for p in patterns:
        m = re.search(r":(\d+)-(\d+)", p)
        out += [f"{p[: m.start()]}:{port}{p[m.end() :]}" for port in range(int(m.group(1)), int(m.group(2)) + 1)] if m else [p]
    return out


def with_endpoint(revisions_: DataFrame, endpoints: list[str], page: str = "pid") -> DataFrame:
    """Rows with the ``endpoint`` that serves their page, one partition an endpoint, a page's rows in order.

    Pages go round; what extracts runs as ``mapInArrow`` on the result, each task
    with one endpoint.
    """
    if not endpoints:
        raise ValueError("no endpoint given")
    at = F.pmod(F.xxhash64(page), F.lit(len(endpoints))).cast("int")
    placed = revisions_.withColumn("_at", at).repartitionById(len(endpoints), F.col("_at")).sortWithinPartitions(page)
    return placed.withColumn("endpoint", F.element_at(F.array(*map(F.lit, endpoints)), F.col("_at") + 1)).drop("_at")


def outcomes(versions: DataFrame) -> DataFrame:
    """(event, revisions, pages, first, last) of the versions (pid, rid, ts, ok): how many were extracted, how many failed, and the time they span."""
    event = F.when(F.col("ok"), "extracted").otherwise("failed").alias("event")
    return versions.groupBy(event).agg(F.count("*").alias("revisions"), F.count_distinct("pid").alias("pages"), F.min("ts").alias("first"), F.max("ts").alias("last"))
