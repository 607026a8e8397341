"""Partition layouts for triples and the star queries that compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.literals import literal_lang, literal_number, literal_value
from kgloom.plans.durable import by_key, more_parts, written
from kgloom.vocab import DBO, RDF_TYPE, RDFS_LABEL

LAYOUTS = {"all": [], "predicate": ["predicate_hash"], "type": ["type_hash"], "type_predicate": ["type_hash", "predicate_hash"]}


def typed_triples(triples: DataFrame) -> DataFrame:
    """Each triple with each type of its subject; those of untyped subjects drop out."""
    types = triples.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("type")).distinct()
    return triples.join(types.hint("shuffle_hash"), "s")  # sorted, the triples would be in the tasks' memory


def write_layout(triples: DataFrame, path: str, layout: str) -> None:
    """Triples as Parquet under a layout: directories by hash of predicate, type, or both."""
    if "type_hash" in LAYOUTS[layout]:
        triples = typed_triples(triples).withColumn("type_hash", F.sha2("type", 256))
    if "predicate_hash" in LAYOUTS[layout]:
        triples = triples.withColumn("predicate_hash", F.sha2("p", 256))
    by = LAYOUTS[layout]
    # hash keys have few values: rows spread over a key's files by subject; a task sorts its rows, so it takes few
    n = more_parts(triples, most=200)
    spread = [*by, F.pmod(F.xxhash64("s"), F.lit(max(8, n or 0)))]
    writer = ((triples.repartition(n, *spread) if n else triples.repartition(*spread)) if by else triples).write
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_layout(spark, path: str, layout: str, predicates: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Triples of a layout that a request asks for; hash columns prune directories."""
    import hashlib

    df = spark.read.parquet(path)
    digest = lambda terms: [hashlib.sha256(t.encode()).hexdigest() for t in terms]
    if predicates is not None:
        df = df.where(F.col("p").isin(predicates))
        if "predicate_hash" in LAYOUTS[layout]:
            df = df.where(F.col("predicate_hash").isin(digest(predicates)))
    if types is not None and "type_hash" in LAYOUTS[layout]:
        df = df.where(F.col("type_hash").isin(digest(types)))
    out = df.select("s", "p", "o", "isLiteral")
    return by_key(out, "s", most=200).distinct() if "type_hash" in LAYOUTS[layout] else out


def _labels(triples: DataFrame, lang: str = "en") -> DataFrame:
    """(s, label): the smallest label of a language."""
    found = triples.where((F.col("p") == RDFS_LABEL) & (literal_lang(F.col("o")) == lang))
    return found.groupBy("s").agg(F.min(literal_value(F.col("o"))).alias("label"))


def _number(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).groupBy("s").agg(F.min(literal_number(F.col("o"))).alias(name))


def _of_type(triples: DataFrame, kind: str) -> DataFrame:
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == kind)).select("s").distinct()


def in_box(triples: DataFrame, kind: str, lat: tuple[float, float], long: tuple[float, float], lat_p: str, long_p: str, n: int = 10) -> DataFrame:
    """(s, label, lat, long): the first n things of a kind, by label, whose place is in a box, edges included."""
    rows = _of_type(triples, kind).join(_number(triples, lat_p, "lat"), "s").join(_number(triples, long_p, "long"), "s").join(_labels(triples), "s")
    return rows.where(F.col("lat").between(*lat) & F.col("long").between(*long)).orderBy("label", "s").limit(n).select("s", "label", "lat", "long")


def largest(triples: DataFrame, kind: str, predicate: str, n: int = 10) -> DataFrame:
    """(s, label, value): the n things of a kind with the largest number."""
    value = triples.where(F.col("p") == predicate).groupBy("s").agg(F.max(literal_number(F.col("o"))).alias("value")).where("value is not null")
    rows = _of_type(triples, kind).join(value, "s").join(_labels(triples), "s")
    return rows.orderBy(F.desc("value"), "s").limit(n).select("s", "label", "value")


def led_to(triples: DataFrame, kind: str, label: str, edge: str) -> DataFrame:
    """(s, target, target_label): where a relation leads from the things of a kind with a label."""
    named = _labels(triples)
    start = _of_type(triples, kind).join(named.where(F.col("label") == label), "s").select("s")
    hop = triples.where(F.col("p") == edge).select("s", F.col("o").alias("target")).distinct()
    return start.join(hop, "s").join(named.select(F.col("s").alias("target"), F.col("label").alias("target_label")), "target").select("s", "target", "target_label")


def overlaps(spark, folder: str, runs: dict) -> DataFrame:
    """(layout, query, rows, shared): each query on each layout below ``folder``, and how many of its rows the unpartitioned layout gives too.

    ``runs``: by name (query, predicates or None, types or None); a query takes
    triples to rows.
    """
    out = None
    for name, (query, predicates, types) in runs.items():
        base = written(query(read_layout(spark, f"{folder}/all", "all")).distinct(), "base")
        for layout in LAYOUTS:
            got = query(read_layout(spark, f"{folder}/{layout}", layout, predicates, types)).distinct()
            rows = got.join(base.withColumn("_in", F.lit(1)), got.columns, "left").agg(F.lit(layout).alias("layout"), F.lit(name).alias("query"), F.count("*").alias("rows"), F.count("_in").alias("shared"))
            out = rows if out is None else out.union(rows)
    return out
