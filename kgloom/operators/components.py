"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.plans.durable import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is the smallest vertex.

    Edges are undirected; loops and rows with a null end connect nothing, but a
    loop's vertex is a component of its own. Each round shrinks every vertex's
    neighbourhood onto its minimum, so rounds grow with the logarithm of the
    longest path. A round's edges are checkpointed, so a lost executor costs at
    most one round.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = cut(pairs.distinct())
    alone = pairs.where("u = v").select("u")
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = found.select(F.col("component").alias("u")).distinct().select("u", F.col("u").alias("component"))
    known = found.union(roots)
    rest = alone.join(known, "u", "left_anti").select("u", F.col("u").alias("component")).distinct()
    return known.union(rest).toDF("vertex", "component")
