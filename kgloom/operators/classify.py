"""Rules that give ontology classes a subject domain.

Scores come from keywords in the class's name, labels and parents' names; the
hierarchy's anchors decide unless the words clearly say otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.literals import camel_tokens

DEFAULT_DOMAIN = "Organizations"
MOST_KEYWORDS = 100_000


def semantic_scores(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """(class, domain, score) of the classes that any keyword speaks for.

    ``names``: (class, name), one row for each of its names; ``keywords``:
    (domain, keyword). A token that is a keyword counts 2; else one that holds
    a keyword of more than five letters counts 1; each distinct token once.
    """
    tokens = names.select("class", F.explode(camel_tokens(F.col("name"))).alias("token")).distinct()
    # a vocabulary of the rules, whose size is the number of comparisons for each token
    if keywords.count() > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    words = F.broadcast(keywords)
    hits = tokens.join(words, F.col("token").contains(F.col("keyword")))
    points = F.when(F.col("token") == F.col("keyword"), 2).when(F.length("keyword") > 5, 1)
    best = hits.withColumn("points", points).where("points is not null").groupBy("class", "domain", "token").agg(F.max("points").alias("points"))
    return best.groupBy("class", "domain").agg(F.sum("points").alias("score"))


def rule_classes(classes: DataFrame, distances: DataFrame, scores: DataFrame, priority: list[str]) -> DataFrame:
    """(class, domain, confidence, source, tags) of each class.

    The hierarchy's nearest domain (ties by ``priority``) stands, with high
    confidence up to two steps; but at two steps or more words with a score of
    4 and a lead of 2 overrule it. Without hierarchy the best score decides,
    without either the default does. Tags: up to three other domains that are
    at most one step further, or score 2.
    """
    spark = classes.sparkSession
    rank = F.broadcast(spark.createDataFrame([(d, i) for i, d in enumerate(priority)], "domain string, place int"))
    near = distances.join(rank, "domain").groupBy("class").agg(
        F.min(F.struct("distance", "place", "domain")).alias("h"), F.collect_list(F.struct("distance", "place", "domain")).alias("hs")
    )
    order = Window.partitionBy("class").orderBy(F.desc("score"), "place")
    scored = scores.join(rank, "domain").withColumn("r", F.row_number().over(order)).groupBy("class").agg(
        F.min_by("domain", "r").alias("word"), F.max("score").alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0)).alias("second"),
        F.collect_list(F.struct("place", "score", "domain")).alias("ws"),
    )
    rows = classes.select("class").distinct().join(near, "class", "left").join(scored, "class", "left")
    lead = F.col("best") - F.col("second")
    override = F.col("h").isNotNull() & (F.col("word") != F.col("h.domain")) & (F.col("h.distance") >= 2) & (F.col("best") >= 4) & (lead >= 2)
    override = F.coalesce(override, F.lit(False))
    domain = F.when(override, F.col("word")).when(F.col("h").isNotNull(), F.col("h.domain")).when(F.col("word").isNotNull(), F.col("word")).otherwise(DEFAULT_DOMAIN)
    confidence = (
        F.when(override, "medium").when(F.col("h").isNotNull(), F.when(F.col("h.distance") <= 2, "high").otherwise("medium"))
        .when(F.col("best") >= 4, "medium").otherwise("low")
    )
    source = F.when(override, "semantic").when(F.col("h").isNotNull(), "hierarchy").when(F.col("word").isNotNull(), "semantic").otherwise("default")
    rows = rows.withColumns({"domain": domain, "confidence": confidence, "source": source})
    by_tree = F.transform(F.sort_array(F.filter("hs", lambda x: x["distance"] <= F.col("h.distance") + 1)), lambda x: x["domain"])
    by_word = F.transform(F.sort_array(F.filter("ws", lambda x: x["score"] >= 2)), lambda x: x["domain"])
    none = F.array().cast("array<string>")
    tags = F.array_remove(F.array_distinct(F.concat(F.coalesce(by_tree, none), F.coalesce(by_word, none))), F.col("domain"))
    return rows.select("class", "domain", "confidence", "source", F.array_join(F.slice(tags, 1, 3), "|").alias("tags"), (F.col("confidence") == "low").alias("manual_review"))
