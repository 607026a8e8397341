"""Facts, triples and entities as lines of RDF text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.literals import instant, is_literal
from kgloom.vocab import OPEN_END, RDF_TYPE, XSD

TKG = "http://ex.org/tkg/"


def iso(t: Column) -> Column:
    """ISO-8601 seconds in UTC; what no calendar holds, like an open end, is the last second of 9999."""
    return F.coalesce(F.date_format(instant(F.when(t < OPEN_END, t)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("9999-12-31T23:59:59"))


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _object(tail: Column) -> Column:
    return F.when(is_literal(tail), tail).otherwise(_cat("<", tail, ">"))


def _lines(df: DataFrame, *lines: Column) -> DataFrame:
    return df.select(F.explode(F.array(*lines)).alias("value"))


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): one line a triple; null terms are skipped."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def trimmed_tails(facts: DataFrame) -> DataFrame:
    """Facts whose tails lose the stray last character that older files have; literals stay."""
    t = F.col("tail")
    return facts.withColumn("tail", F.when(is_literal(t), t).otherwise(F.substring(t, F.lit(1), F.length(t) - 1)))


def nquads(facts: DataFrame) -> DataFrame:
    """Three quads a fact: the triple in its window's graph, and the window's ends."""
    g = _cat("<", TKG, F.col("rStart"), "-", F.col("rEnd"), ">")
    end = lambda name, t: _cat(g, " <", TKG, name, "> \"", iso(F.col(t)), f'"^^<{XSD}dateTime> <{TKG}> .')
    return _lines(facts, _cat("<", F.col("head"), "> <", F.col("rel"), "> ", _object(F.col("tail")), " ", g, " ."), end("start", "tStart"), end("end", "tEnd"))


def named_graphs(facts: DataFrame) -> DataFrame:
    """Five quads a fact, in a graph named by a digest of the fact."""
    # a column of its own: in the lines it would be worked out for each of them
    facts, g = facts.withColumn("_g", _cat(f"<{TKG}population", F.md5(F.concat_ws("|", "head", "rel", "tail", "rStart", "tStart")), ">")), F.col("_g")
    lit = lambda name, value, kind: _cat(g, f" <{TKG}{name}> \"", value, f'"^^<{XSD}{kind}> <{TKG}meta> .')
    return _lines(
        facts,
        _cat("<", F.col("head"), "> <", F.col("rel"), "> ", _object(F.col("tail")), " ", g, " ."),
        lit("rStart", F.col("rStart"), "string"), lit("rEnd", F.col("rEnd"), "string"),
        lit("tStart", iso(F.col("tStart")), "dateTime"), lit("tEnd", iso(F.col("tEnd")), "dateTime"),
    )


def reification(facts: DataFrame) -> DataFrame:
    """Eight triples a fact about a blank node named by a digest of the fact."""
    facts, b = facts.withColumn("_b", _cat("_:b", F.md5(F.concat_ws("|", "head", "rel", "tail", "rStart", "tStart")))), F.col("_b")
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    lit = lambda name, value, kind: _cat(b, f" <{TKG}{name}> \"", value, f'"^^<{XSD}{kind}> .')
    return _lines(
        facts,
        _cat(b, f" <{rdf}type> <{rdf}Statement> ."),
        _cat(b, f" <{rdf}subject> <", F.col("head"), "> ."),
        _cat(b, f" <{rdf}predicate> <", F.col("rel"), "> ."),
        _cat(b, f" <{rdf}object> ", _object(F.col("tail")), " ."),
        lit("rStart", F.col("rStart"), "string"), lit("rEnd", F.col("rEnd"), "string"),
        lit("tStart", iso(F.col("tStart")), "dateTime"), lit("tEnd", iso(F.col("tEnd")), "dateTime"),
    )


def rdf_star(facts: DataFrame) -> DataFrame:
    """Four statements a fact about the quoted triple."""
    q = _cat("<< <", F.col("head"), "> <", F.col("rel"), "> ", _object(F.col("tail")), " >>")
    lit = lambda name, value, kind: _cat(q, f" <{TKG}{name}> \"", value, f'"^^<{XSD}{kind}> .')
    return _lines(facts, lit("rStart", F.col("rStart"), "string"), lit("rEnd", F.col("rEnd"), "string"), lit("tStart", iso(F.col("tStart")), "dateTime"), lit("tEnd", iso(F.col("tEnd")), "dateTime"))


def escaped(value: Column) -> Column:
    """Text as it stands between the quotes of a literal."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def class_name(source: Column) -> Column:
    """A source's name as a class: ``www.`` and dots go, title case."""
    return F.initcap(F.replace(F.regexp_replace(source, r"^www\.", ""), F.lit("."), F.lit(" ")))


def property_name(key: Column) -> Column:
    """camelCase of a property's name."""
    words = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(key, "[<>]", ""), "[^A-Za-z0-9]+", " ")))
    joined = F.replace(words, F.lit(" "), F.lit(""))
    first = F.length(F.substring_index(words, " ", 1))
    return F.concat(F.lower(F.substring(joined, F.lit(1), first)), F.substring(joined, first + 1, F.length(joined)))


def entity_ntriples(entities: DataFrame, namespace: str) -> DataFrame:
    """(value): each entity's class and its properties that have a value; literals are escaped."""
    kind = entities.select(_cat("<", F.col("identifier"), f"> {RDF_TYPE} <{namespace}", F.replace(class_name(F.col("source")), F.lit(" "), F.lit("")), "> .").alias("value"))
    each = entities.select("identifier", F.explode("properties").alias("k", "v")).where("v is not null")
    return kind.union(each.select(_cat("<", F.col("identifier"), f"> <{namespace}", property_name(F.col("k")), '> "', escaped(F.col("v")), '" .').alias("value")))


def ontology_turtle(entities: DataFrame, namespace: str, object_properties: list[str]) -> DataFrame:
    """(value): a declaration of every class and property that occurs."""
    classes = entities.select(_cat(f"<{namespace}", F.replace(class_name(F.col("source")), F.lit(" "), F.lit("")), "> a owl:Class .").alias("value")).distinct()
    names = entities.select(F.explode(F.map_keys("properties")).alias("k")).distinct()
    kind = F.when(F.col("k").isin(object_properties), "owl:ObjectProperty").otherwise("owl:DatatypeProperty")
    return classes.union(names.select(_cat(f"<{namespace}", property_name(F.col("k")), "> a ", kind, " .").alias("value")).distinct())


def source_graph(entities: DataFrame, membership: DataFrame, namespace: str) -> DataFrame:
    """(value): entities with their source, cluster and non-empty properties; http(s) values are IRIs."""
    e = _cat("<", F.col("identifier"), ">")
    kind = entities.select(_cat(e, f" {RDF_TYPE} <{namespace}Entity> .").alias("value"))
    origin = entities.select(_cat(e, f" <{namespace}hasSource> <{namespace}source/", F.col("source"), "> .").alias("value"))
    member = entities.select("identifier").join(membership, F.col("identifier") == F.col("entity_id"))
    member = member.select(_cat(e, f" <{namespace}belongsToCluster> <{namespace}cluster/", F.col("cluster_id"), "> .").alias("value"))
    each = entities.select("identifier", F.explode("properties").alias("k", "v")).where("v is not null and v <> ''")
    value = F.when(F.col("v").rlike("^https?://"), _cat("<", F.col("v"), ">")).otherwise(_cat('"', escaped(F.col("v")), '"'))
    return kind.union(origin).union(member).union(each.select(_cat(e, f" <{namespace}", property_name(F.col("k")), "> ", value, " .").alias("value")))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Row numbers from 0 in a total order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; only the partitions' sizes meet on
    the driver. The rows are written first, so that numbers hold on a rerun.
    """
    from kgloom.plans.durable import written

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, at = [], 0
    for p, c in sizes:
        starts.append((p, at))
        at += c
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_r", rank).join(table, "_part").withColumn(name, F.col("_start") + F.col("_r")).drop("_part", "_start", "_r")
