"""From raw documents to packed training bins, in five stages.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame. It is
written as Parquet and read again as the next stage's documents, so a stage that
fails is run again from its predecessor's table.

Null, empty and blank texts are rejected by the first stage. Of rows with one
text the smallest id stays, a null id being the largest; of near copies too. Ties
go by id, and between equal ids by a hash of the row. Texts of any length are
read whole, and packed in pieces. The fourth stage drops nothing: it lays the
documents out in mixture order, and the fifth packs runs of that order, so that
the bins of a group have the mixture's proportions as long as its sources last.
Columns beyond those of ``documents`` are carried up to the last stage, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import exact, mixing, packing, quality, simhash
from kgloom.llm.queries import MIX_WEIGHTS
from kgloom.plans.durable import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines removed, depleted documents rejected."""
    return quality.remove_frequent_lines(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the schedule of target weights."""
    return mixing.in_order(docs, MIX_WEIGHTS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin; groups of bins follow the order of the documents."""
    return packing.pack(docs, in_order=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SimHash search and best-fit packing are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a table in the shared folder between two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
