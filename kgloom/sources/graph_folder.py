"""Folders with vertices and similarity edges, as JSON lines or as CSV with a metadata file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.graph import loaded_edges

_VERTEX = "id string, data_io map<string,string>"
_EDGE = "source string, target string, data_io struct<value:double>"


def json_vertices(raw: DataFrame) -> DataFrame:
    """Entities of rows (id, data_io): ``srcId`` names the source, the rest are properties."""
    return raw.select(F.col("id").alias("identifier"), F.try_element_at("data_io", F.lit("srcId")).alias("source"), F.map_filter("data_io", lambda k, _: k != "srcId").alias("properties"))


def json_edges(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("data_io.value").alias("sim"))


def _split(column: str, sep: str):
    return F.split(column, rf"(?<!\\)\{sep}")


def _plain(c):
    return F.regexp_replace(c, r"\\([;|,:\\])", "$1")


def csv_metadata(lines: DataFrame) -> DataFrame:
    """(source, names): the attribute names of each source, in order, from lines ``v;source;name:type,...``."""
    p = _split("value", ";")
    rows = lines.where(F.col("value").startswith("v;")).select(F.get(p, F.lit(1)).alias("source"), _split(F.get(p, F.lit(2)), ",").alias("a"))
    return rows.select("source", F.transform("a", lambda x: F.regexp_replace(x, r"(?<!\\):.*$", "")).alias("names"))


def csv_vertices(lines: DataFrame, metadata: DataFrame) -> DataFrame:
    """Entities from lines ``id;graph;source;v1|v2|...``; empty values are left out, ``gtId`` becomes ``recId``."""
    p = _split("value", ";")
    rows = lines.select(F.rtrim(F.col("value")).alias("value")).where("value <> ''").select(F.get(p, F.lit(0)).alias("identifier"), F.get(p, F.lit(2)).alias("source"), F.get(p, F.lit(3)).alias("v"))
    rows = rows.join(metadata, "source").withColumn("v", _split("v", "|"))
    pairs = F.arrays_zip("names", "v")
    keep = F.filter(pairs, lambda x: x["names"].isNotNull() & x["v"].isNotNull() & (x["v"] != ""))
    entry = F.transform(keep, lambda x: F.struct(F.when(x["names"] == "gtId", "recId").otherwise(_plain(x["names"])), _plain(x["v"])))
    return rows.select("identifier", "source", F.map_from_entries(entry).alias("properties"))


def csv_edges(lines: DataFrame) -> DataFrame:
    """Edges from lines ``id;graph;src;dst;label;sim``."""
    p = _split("value", ";")
    return lines.where("trim(value) <> ''").select(F.get(p, F.lit(2)).alias("src"), F.get(p, F.lit(3)).alias("dst"), F.trim(F.get(p, F.lit(5))).try_cast("double").alias("sim"))


def read_graph(spark: SparkSession, folder: str, kind: str | None = None, sources: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a folder; edges whose ends aren't both loaded are dropped.

    ``kind``: json or csv; by default the one that the folder has files of.
    ``sources``: only the vertices of two sources.
    """
    if kind is None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        names = [str(f.getPath().getName()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
        kind = "json" if any("json" in n for n in names) else "csv"
    if kind == "json":
        entities = json_vertices(spark.read.schema(_VERTEX).json(f"{folder}/vertices.json"))
        edges = json_edges(spark.read.schema(_EDGE).json(f"{folder}/edges.json"))
    elif kind == "csv":
        entities = csv_vertices(spark.read.text(f"{folder}/vertices.csv"), csv_metadata(spark.read.text(f"{folder}/metadata.csv")))
        edges = csv_edges(spark.read.text(f"{folder}/edges.csv"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    if sources:
        entities = entities.where(F.col("source").isin(*sources))
    return entities, loaded_edges(edges, entities)
