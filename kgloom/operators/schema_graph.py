"""The graph of types and relations that a set of triples instantiates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.literals import any_property
from kgloom.operators.triples import is_type


def schema_graph(triples: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """(SourceType, Relation, TargetType, Count) of all triples whose predicate passes the filters.

    Types come from the whole input. A subject or object with several types
    counts for each; one without is ``Untyped``; literals are ``Literal``.

    Triples are counted by (subject's types, relation, object), so hubs with
    many triples meet their types as counts.
    """
    types = triples.where(is_type()).select(F.col("s").alias("e"), F.col("o").alias("type")).distinct().groupBy("e").agg(F.collect_list("type").alias("types"))
    rows = triples.where(any_property(F.col("p"), filters)).select("s", "p", F.when(~F.col("isLiteral"), F.col("o")).alias("o"), "isLiteral")
    untyped = F.array(F.lit("Untyped"))
    left = rows.join(types.select(F.col("e").alias("s"), F.col("types").alias("st")), "s", "left")
    left = left.groupBy(F.coalesce("st", untyped).alias("st"), "p", "o", "isLiteral").agg(F.count("*").alias("n"))
    both = left.join(types.select(F.col("e").alias("o"), F.col("types").alias("ot")), "o", "left")
    target = F.when(F.col("isLiteral"), F.array(F.lit("Literal"))).otherwise(F.coalesce("ot", untyped))
    both = both.groupBy("st", "p", target.alias("tt")).agg(F.sum("n").alias("n"))
    out = both.select(F.explode("st").alias("SourceType"), F.col("p").alias("Relation"), "tt", "n").select("SourceType", "Relation", F.explode("tt").alias("TargetType"), "n")
    return out.groupBy("SourceType", "Relation", "TargetType").agg(F.sum("n").alias("Count"))
