"""Filters, joins and aggregates over RDF triples (s, p, o, isLiteral).

Unless said otherwise an operator keeps the multiplicity of its input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.literals import any_property, is_literal
from kgloom.plans.durable import more_parts
from kgloom.vocab import DBO, RDF_TYPE, RDFS_LABEL

def is_type() -> Column:
    """Whether the predicate is rdf:type, written out or as ``a``."""
    return F.col("p").isin(RDF_TYPE, "a")


def typed_as(triples: DataFrame, types: list[str], short: bool = False) -> DataFrame:
    """(s): distinct subjects with one of the types; ``short`` also takes the predicate ``a``."""
    return triples.where((is_type() if short else F.col("p") == RDF_TYPE) & F.col("o").isin(types)).select("s").distinct()


def having(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``keys``, which may repeat.

    A task hashes its share of the keys and lets its rows pass by; sorted, the
    rows would all be in its memory.
    """
    return rows.join(keys.toDF("_key").hint("shuffle_hash"), F.col(key) == F.col("_key"), "left_semi")


def with_types(triples: DataFrame, types: list[str]) -> DataFrame:
    """All triples of subjects that have one of the types."""
    return having(triples, "s", triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(types)).select("s"))


def with_all_types(triples: DataFrame, types: list[str]) -> DataFrame:
    """All triples of subjects that have every one of the types."""
    found = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(types)).groupBy("s").agg(F.count_distinct("o").alias("n")).where(F.col("n") == len(set(types)))
    return having(triples, "s", found.select("s"))


def only_types(triples: DataFrame, types: list[str]) -> DataFrame:
    """Triples without the rdf:type statements of other types."""
    return triples.where((F.col("p") != RDF_TYPE) | F.col("o").isin(types))


def connected_objects(triples: DataFrame) -> DataFrame:
    """Literal and type triples, and those whose object is a subject somewhere."""
    keep = F.col("isLiteral") | is_type()
    return triples.where(keep).unionByName(having(triples.where(~keep), "o", triples.select("s").distinct()))


def class_subgraph(triples: DataFrame, classes: list[str]) -> DataFrame:
    """The set of triples among instances of the classes, with their literals and class statements."""
    classes = [c.strip() for c in classes if c.strip()]
    if not classes:
        raise ValueError("no class given")
    own = typed_as(triples, classes, short=True)
    mine = having(triples, "s", own)
    keep = F.col("isLiteral") | (is_type() & F.col("o").isin(classes))
    links = having(mine.where(~keep), "o", own)
    return mine.where(keep).unionByName(links).distinct()


def with_predicate(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate)


def with_properties(triples: DataFrame, filters: list[str] | None = None) -> DataFrame:
    return triples.where(any_property(F.col("p"), filters))


def by_namespace(triples: DataFrame) -> DataFrame:
    """Triples with the namespace group of their predicate: abstract, ontology, property or other."""
    group = F.when(F.col("p") == f"<{DBO}abstract>", "abstract").when(F.col("p").startswith(f"<{DBO}"), "ontology").when(F.col("p").startswith("<http://dbpedia.org/property/"), "property")
    return triples.withColumn("namespace", F.coalesce(group, F.lit("other")))


def untyped_removed(triples: DataFrame) -> DataFrame:
    """Triples of subjects with any type."""
    return having(triples, "s", triples.where(is_type()).select("s"))


def types_from_relations(triples: DataFrame, domains: dict[str, str], ranges: dict[str, str]) -> DataFrame:
    """Distinct (s, type) that follow from predicates' domains and ranges."""
    spark = triples.sparkSession

    def known(of: dict, term: Column, rows: DataFrame) -> DataFrame:
        table = F.broadcast(spark.createDataFrame(sorted(of.items()), "p string, type string"))
        return rows.join(table, "p").select(term.alias("s"), "type")

    return known(domains, F.col("s"), triples).union(known(ranges, F.col("o"), triples.where(~F.col("isLiteral")))).distinct()


def triple_join(left: DataFrame, right: DataFrame, left_on: str = "o", right_on: str = "s") -> DataFrame:
    """Pairs of triples that meet in a position; columns of the second end in 2."""
    right = right.select(*[F.col(c).alias(f"{c}2") for c in ("s", "p", "o")])
    return left.select("s", "p", "o").join(right, F.col(left_on) == F.col(f"{right_on}2"))


def matching(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that fit a pattern; None fits any term."""
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is not None:
            triples = triples.where(F.col(name) == term)
    return triples


def project(triples: DataFrame, columns: list[str]) -> DataFrame:
    return triples.select(*columns)


def aggregate(triples: DataFrame, by: str = "p") -> DataFrame:
    """(by, triples, subjects, objects) per term of a position; the two last count distinct terms."""
    return triples.groupBy(by).agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def type_frequency(triples: DataFrame) -> DataFrame:
    """(type, entities): distinct subjects of each type."""
    return triples.where(is_type()).groupBy(F.col("o").alias("type")).agg(F.count_distinct("s").alias("entities"))


def related_by_property(triples: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Distinct (entity, kind, related): targets of properties that lead to a kind of thing."""
    table = F.broadcast(triples.sparkSession.createDataFrame(sorted(kinds.items()), "p string, kind string"))
    return triples.where(~is_literal(F.col("o"))).join(table, "p").select(F.col("s").alias("entity"), "kind", F.col("o").alias("related")).distinct()


def shade_namespace(triples: DataFrame, old: str, new: str) -> DataFrame:
    """Subjects and objects of one namespace renamed to a digest in another; predicates stay."""

    def shaded(term: Column) -> Column:
        return F.when(term.startswith(f"<{old}"), F.concat(F.lit(f"<{new}"), F.md5(term), F.lit(">"))).otherwise(term)

    return triples.withColumns({"s": shaded(F.col("s")), "o": shaded(F.col("o"))})


def mapped_properties(triples: DataFrame, mapping: list[tuple[str, str, str]]) -> DataFrame:
    """Triples under new predicates: rows (old predicate, new predicate, LITERAL or OBJECT); others are left out."""
    table = F.broadcast(triples.sparkSession.createDataFrame(mapping, "p string, p_new string, kind string"))
    rows = triples.join(table, "p").where((F.col("kind") == "LITERAL") == F.col("isLiteral"))
    return rows.select("s", F.col("p_new").alias("p"), "o", "isLiteral")


def replace_namespace(triples: DataFrame, old: str, new: str) -> DataFrame:
    """Terms of one namespace moved to another, in any position; literals stay."""

    def moved(term: Column) -> Column:
        return F.when(term.startswith(f"<{old}"), F.concat(F.lit(f"<{new}"), F.substring(term, F.lit(len(old) + 2), F.length(term)))).otherwise(term)

    return triples.withColumns({c: moved(F.col(c)) for c in ("s", "p", "o")})


def with_alt_labels(triples: DataFrame) -> DataFrame:
    """The triples and a skos:altLabel beside every rdfs:label."""
    copies = triples.where(F.col("p") == RDFS_LABEL).withColumn("p", F.lit("<http://www.w3.org/2004/02/skos/core#altLabel>"))
    return triples.unionByName(copies)


def one_level(triples: DataFrame) -> DataFrame:
    """(s, json): each subject's predicates with their sorted distinct objects."""
    objects = triples.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("os"))
    rows = objects.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "os"))).alias("e"))
    return rows.select("s", F.to_json(F.map_from_entries("e")).alias("json"))


def nested(triples: DataFrame, depth: int = 1) -> DataFrame:
    """(s, json): each subject as ``{"@id": s, p: [objects...]}``, predicates and objects in order.

    Down to ``depth`` an object that is a subject itself stands as such a JSON
    object in its place, below that as its name; depth 0 is one level. So cycles
    end at the depth. One join a level.
    """
    if depth < 0:
        raise ValueError("depth can't be negative")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    n = more_parts(triples, most=200)
    met = lambda rows: rows.repartition(n, "s") if n else rows.repartition("s")
    facts = met(triples.select("s", "p", "o")).distinct()
    inner = having(facts, "s", facts.select("o").distinct())
    level = None
    for k in range(depth + 1):
        rows = facts if k == depth else inner
        if level is not None:
            rows = met(rows.join(level.select(F.col("s").alias("o"), "json"), "o", "left").select("s", "p", "o", "json"))
        value = quoted(F.col("o")) if level is None else F.coalesce("json", quoted(F.col("o")))
        each = rows.groupBy("s", "p").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", value.alias("v")))), lambda x: x["v"]).alias("vs"))
        entry = F.concat(quoted(F.col("p")), F.lit(":["), F.array_join("vs", ","), F.lit("]"))
        level = each.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", entry.alias("e")))).alias("es"))
        level = level.select("s", F.concat(F.lit('{"@id":'), quoted(F.col("s")), F.lit(","), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("}")).alias("json"))
    return level
