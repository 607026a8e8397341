"""Triples and facts from text files and generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.plans.durable import parts
from kgloom.schema import FACTS

PART = 64 << 20

_STRICT = r'^\s*(?:<[^>\s]*>|_:\S+)\s+<[^>\s]*>\s+(?:<[^>\s]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9\-]+|\^\^<[^>\s]*>)?)\s*\.\s*$'


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, isLiteral) of each line ``s p o .``; comments, blank and other lines are dropped.

    The object is all from the third term to the final dot, so a graph name
    stays inside it.
    """
    blank = F.lit(" \t\n\x0b\f\r")
    rows = lines.select(F.trim(F.col(column), blank).alias("l")).where((F.col("l") != "") & ~F.col("l").startswith("#") & F.col("l").endswith("."))
    # a generator keeps the split from being worked out anew for every use of a part
    rows = rows.select(F.explode(F.array(F.split("l", r"\s+", 3))).alias("t")).where(F.size("t") == 3)
    rest = F.get("t", F.lit(2))
    o = F.rtrim(F.substring(rest, F.lit(1), F.length(rest) - 1), blank)
    rows = rows.select(F.get("t", F.lit(0)).alias("s"), F.get("t", F.lit(1)).alias("p"), o.alias("o"))
    return rows.where("o <> ''").withColumn("isLiteral", F.col("o").startswith('"'))


def strict(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are a triple by the letter."""
    return lines.where(F.col(column).rlike(_STRICT))


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def unwrapped(lines: DataFrame, column: str = "value") -> DataFrame:
    """(head, rel, tail) of N-Triples lines, IRIs without brackets, literals as they stand."""
    t = parse_ntriples(lines, column)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    return t.select(bare("s").alias("head"), bare("p").alias("rel"), F.when(F.col("isLiteral"), F.col("o")).otherwise(bare("o")).alias("tail"))


def as_facts(df: DataFrame) -> DataFrame:
    """Facts with times as longs; times that are no number become null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in FACTS])


def rejected(df: DataFrame) -> DataFrame:
    """The rows whose times ``as_facts`` can't read."""
    bad = lambda c: F.col(c).isNotNull() & F.col(c).try_cast("bigint").isNull()
    return df.where(bad("tStart") | bad("tEnd"))


def read_facts(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Facts from Parquet, or from JSON lines or CSV with all columns as text."""
    if kind == "parquet":
        return as_facts(spark.read.parquet(path))
    text = ", ".join(f"{c} string" for c in FACTS.names)
    if kind == "json":
        return as_facts(spark.read.schema(text).json(path))
    if kind == "csv":
        return as_facts(spark.read.csv(path, header=True, schema=text, unescapedQuoteHandling="BACK_TO_DELIMITER", enforceSchema=False))
    raise ValueError(f"unknown kind {kind!r}")


def write_ntriples(triples: DataFrame, path: str, compression: str | None = None) -> None:
    """Lines of N-Triples; an existing path is an error."""
    from kgloom.operators.serialize import ntriples

    writer = ntriples(triples).write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_extraction(facts: DataFrame, path: str, form: str = "csv") -> None:
    """Extracted facts as CSV with a header, or as quads (``ngraph``), compressed as their lines repeat each other."""
    if form == "csv":
        facts.write.mode("errorifexists").csv(path, header=True)
    elif form == "ngraph":
        from kgloom.operators.serialize import nquads

        nquads(facts).write.mode("errorifexists").text(path, compression="gzip")
    else:
        raise ValueError(f"unknown form {form!r}")


def write_report(df: DataFrame, folder: str, name: str, files: int | None = 1) -> None:
    """A result as CSV under its own name; ``files`` None keeps the partitions."""
    (df.coalesce(files) if files else df).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def convert(spark: SparkSession, source: str, target: str, kind: str, to: str = "parquet", partitions: int | None = None) -> int:
    """A table in another format; returns the number of rows written, which must equal those read.

    ``partitions``: as many parts, or one for each ``PART`` bytes of the source where those are more.
    """
    df = spark.read.format(kind).options(header=True, inferSchema=False).load(source) if kind == "csv" else spark.read.format(kind).load(source)
    n = df.count()
    out = df.repartition(max(partitions, parts(df, PART))) if partitions else df
    out.write.mode("errorifexists").options(header=True).format(to).save(target)
    back = (spark.read.options(header=True) if to == "csv" else spark.read).format(to).load(target).count()
    if back != n:
        raise OSError(f"{back} rows in {target}, {n} in {source}")
    return n
