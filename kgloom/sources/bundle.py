"""Dataset bundles: subsets of entities with their triples, texts and links, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kgloom.plans.durable import written


def write_bundle(folder: str, subsets: DataFrame, triples: DataFrame, texts: DataFrame, seed_split: int = 0) -> DataFrame:
    """Writes a bundle and returns its manifest (split, part, rows, entities), counted from the files.

    ``subsets``: (split int, s); ``triples``: (s, p, o, isLiteral); ``texts``:
    (s, text). Below the folder, each partitioned by split: ``seed`` (the triples
    of split ``seed_split``), ``rdf`` (the triples of each split), ``reference``
    (those of the split and of all before it), ``text`` (texts that aren't
    empty), ``links`` (which text belongs to which entity) and ``provenance``
    (where an entity is found). A part whose files don't hold what was to be
    written is an error.
    """
    spark = subsets.sparkSession
    # each input is gone through once: the parts are made of what the subsets have of it
    subsets = written(subsets, "subsets")
    own = subsets.select("s").distinct()
    triples = written(triples.join(own, "s", "left_semi"), "own")
    texts = written(texts.join(own, "s", "left_semi"), "texts")
    rdf = triples.join(subsets, "s")
    last = subsets.agg(F.max("split")).first()[0]
    first = subsets.groupBy("s").agg(F.min("split").alias("split"))
    # an entity's triples count in the reference of its first split and of all later ones
    reference = triples.join(first, "s").withColumn("split", F.explode(F.sequence("split", F.lit(last if last is not None else 0))))
    text = texts.where("text <> ''").join(subsets, "s")
    parts = {
        "seed": rdf.where(F.col("split") == seed_split), "rdf": rdf, "reference": reference, "text": text,
        "links": text.select("s", F.concat(F.md5("s"), F.lit(".txt")).alias("doc_id"), "split"),
        "provenance": subsets.select("s", F.lit("rdf").alias("kind"), "split"),
    }
    manifest = None
    for name, df in parts.items():
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("errorifexists").partitionBy("split").parquet(f"{folder}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        if back.count() != seen.get["n"]:
            raise OSError(f"{folder}/{name} doesn't hold what was written")
        rows = back.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("s").alias("entities")).select("split", F.lit(name).alias("part"), "rows", "entities")
        manifest = rows if manifest is None else manifest.unionByName(rows)
    return manifest
