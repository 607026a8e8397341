"""Record-linkage benchmarks: tables of two sources and the pairs that match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_entities(df: DataFrame, source: str, id_column: str = "id") -> DataFrame:
    """A table's rows as entities; null values are no properties."""
    cells = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns if c != id_column])
    filled = F.filter(cells, lambda x: x["v"].isNotNull())
    return df.select(F.col(f"`{id_column}`").cast("string").alias("identifier"), F.lit(source).alias("source"), F.map_from_entries(filled).alias("properties"))


def read_table(spark: SparkSession, path: str, source: str, id_column: str = "id") -> DataFrame:
    """Entities of a CSV (UTF-8, with or without a byte order mark, if it decodes as such, else Latin-1) or JSON-lines file."""
    if path.endswith((".json", ".jsonl", ".json.gz")):
        return as_entities(spark.read.json(path), source, id_column)
    # lines are looked at one by one, so that no file has to fit a cell
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="ISO-8859-1" if broken else "UTF-8")
    df = df.toDF(*[c.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf") for c in df.columns])
    return as_entities(df, source, id_column)


def read_truth(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """(id1, id2) of the matching pairs."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(F.col(left).alias("id1"), F.col(right).alias("id2"))


def product_pairs(rows: DataFrame, columns: tuple[str, ...] = ("title", "description", "brand")) -> tuple[DataFrame, DataFrame]:
    """(entities, pairs) of rows with ``*_left`` and ``*_right`` columns and a label; null texts are empty."""

    def side(s: str) -> DataFrame:
        props = [x for c in columns if f"{c}_{s}" in rows.columns for x in (F.lit(c), F.coalesce(F.col(f"{c}_{s}").cast("string"), F.lit("")))]
        return rows.select(F.col(f"id_{s}").cast("string").alias("identifier"), F.lit(s).alias("source"), F.create_map(*props).alias("properties"))

    both = side("left").unionByName(side("right"))
    # one entity an id and source; of several the largest by content, so that reruns agree
    one = both.groupBy("identifier", "source").agg(F.max_by("properties", F.to_json("properties")).alias("properties"))
    pairs = rows.select(F.col("id_left").cast("string").alias("id1"), F.col("id_right").cast("string").alias("id2"), (F.col("label").cast("int") == 1).alias("is_match"))
    return one, pairs


def gold_pairs(pairs: DataFrame, corpus: DataFrame, key: str = "identifier") -> DataFrame:
    """Matching pairs both of whose ids are in the corpus."""
    ids = corpus.select(F.col(key).cast("string").alias("_id")).distinct()
    return pairs.where("is_match").join(ids, F.col("id1") == F.col("_id"), "left_semi").join(ids, F.col("id2") == F.col("_id"), "left_semi")
