"""Entities (identifier, source, properties), their benchmarks and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.plans.durable import written

_SALTS = 32


def filter_entities(entities: DataFrame, criteria: dict[str, str | None]) -> DataFrame:
    """Entities that have every named property with the given value; an absent key fits nothing, not even None."""
    for k, v in criteria.items():
        entities = entities.where(F.map_contains_key("properties", F.lit(k)) & F.try_element_at("properties", F.lit(k)).eqNullSafe(F.lit(v)))
    return entities


def project_entities(entities: DataFrame, properties: list[str]) -> DataFrame:
    """Entities with only those of the properties that they have."""
    return entities.withColumn("properties", F.map_filter("properties", lambda k, _: k.isin(properties)))


def _key(name: str) -> Column:
    return F.col("identifier") if name == "identifier" else F.try_element_at("properties", F.lit(name))


def join_entities(left: DataFrame, right: DataFrame, key: str = "identifier", how: str = "inner") -> DataFrame:
    """(left, right) identifiers of entities whose key is equal; a missing property equals a missing one.

    So all entities without the property meet; their pairs are spread over
    ``_SALTS`` tasks, each of which has a part of the left ones and all right ones.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    a = left.select(F.col("identifier").alias("left"), _key(key).alias("_a"))
    b = right.select(F.col("identifier").alias("right"), _key(key).alias("_b"))
    a = a.withColumn("_s", F.when(F.col("_a").isNull(), F.pmod(F.xxhash64("left"), F.lit(_SALTS))).otherwise(0).cast("int"))
    b = b.withColumn("_t", F.explode(F.when(F.col("_b").isNull(), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")) & (F.col("_s") == F.col("_t")), how).select("left", "right")


def entity_classes(left: DataFrame, right: DataFrame, key: str = "identifier", how: str = "inner") -> DataFrame:
    """(side, identifier, class, links): the join of ``join_entities`` by classes of equal keys, one row an entity.

    Every left entity of a class is linked with every right one of it, so the
    classes hold all pairs and their number is that of the entities, however
    many share a key or lack it. A class is named by its smallest left
    identifier; ``links`` counts an entity's pairs. Right entities without a
    left one have none and drop out, left ones too unless ``how`` is left.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    side = lambda e, name: e.select(F.lit(name).alias("side"), "identifier", _key(key).alias("_k"))
    both = written(side(left, "left").union(side(right, "right")), "keys")
    is_left = F.col("side") == "left"

    def classes(groups) -> DataFrame:
        found = groups.agg(F.min(F.when(is_left, F.col("identifier"))).alias("class"), F.count_if(is_left).alias("_l"), F.count_if(~is_left).alias("_r"))
        return found.where("_l > 0" if how == "left" else "_l > 0 and _r > 0")

    known, none = both.where("_k is not null"), both.where("_k is null")
    # those without the key are one class, whose row goes to all of them
    rows = known.join(classes(known.groupBy("_k")), "_k").select("side", "identifier", "class", "_l", "_r")
    rows = rows.union(none.crossJoin(F.broadcast(classes(none))).select("side", "identifier", "class", "_l", "_r"))
    return rows.select("side", "identifier", "class", F.when(is_left, F.col("_r")).otherwise(F.col("_l")).alias("links"))


def aggregate_entities(entities: DataFrame, by: str, value: str) -> DataFrame:
    """(by, entities, min, max, avg) of a numeric property for each value of another."""
    rows = entities.select(_key(by).alias(by), _key(value).try_cast("double").alias("v"))
    return rows.groupBy(by).agg(F.count("*").alias("entities"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg"))


def entity_statistics(entities: DataFrame) -> DataFrame:
    some = F.size("properties") > 0
    return entities.agg(F.count("*").alias("total"), F.count_if(some).alias("with_properties"), F.count_if(~some).alias("without_properties"))


def missing_counts(entities: DataFrame) -> DataFrame:
    """(property, missing): entities without the key, for every key that occurs."""
    total = entities.agg(F.count("*").alias("total"))
    have = entities.select(F.explode(F.map_keys("properties")).alias("property")).groupBy("property").agg(F.count("*").alias("have"))
    return have.crossJoin(F.broadcast(total)).select("property", (F.col("total") - F.col("have")).alias("missing"))


def labelled(pairs: DataFrame, label: str) -> DataFrame:
    """Pairs that are a match, a non_match or unlabeled."""
    m = F.col("is_match")
    return pairs.where({"match": m, "non_match": ~m, "unlabeled": m.isNull()}[label])


def _labels() -> list[Column]:
    m = F.col("is_match")
    return [F.count("*").alias("pairs"), F.count_if(m).alias("matches"), F.count_if(~m).alias("non_matches"), F.count_if(m.isNull()).alias("unlabeled")]


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Label counts and ratios of each split, and of all (split ``total``)."""
    rows = pairs.rollup("split").agg(*_labels(), F.grouping_id().alias("_g"))
    ratio = lambda c: F.try_divide(F.col(c).cast("double"), F.col("pairs"))
    return rows.select(
        F.when(F.col("_g") == 1, "total").otherwise(F.col("split")).alias("split"), "pairs", "matches", "non_matches", "unlabeled",
        ratio("matches").alias("match_ratio"), ratio("non_matches").alias("non_match_ratio"), ratio("unlabeled").alias("unlabeled_ratio"),
    )


def schema_matching_metrics(schemas: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per split and in total: schemas, mean attributes, mappings and their labels; (split, name, attributes) and (split, is_match)."""
    name = F.when(F.col("_g") == 1, "total").otherwise(F.col("split")).alias("split")
    s = schemas.rollup("split").agg(F.count("*").alias("schemas"), F.avg(F.size("attributes")).alias("avg_attributes"), F.grouping_id().alias("_g")).select(name, "schemas", "avg_attributes")
    m = mappings.rollup("split").agg(*_labels(), F.grouping_id().alias("_g")).withColumnRenamed("pairs", "mappings").select(name, "mappings", "matches", "non_matches", "unlabeled")
    counts = ["schemas", "mappings", "matches", "non_matches", "unlabeled"]
    return s.join(m, "split", "full").na.fill(0, counts)


def fusion_metrics(clusters: DataFrame) -> DataFrame:
    """Of (cluster_id, entity_id, fused_id): clusters, entities, fused clusters and the spread of sizes."""
    each = clusters.groupBy("cluster_id").agg(F.count("entity_id").alias("n"), F.max("fused_id").isNotNull().alias("fused"))
    return each.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("entities"), F.count_if("fused").alias("fused"), F.avg("n").alias("avg_size"),
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.try_divide(F.count_if("fused").cast("double"), F.count("*")).alias("fusion_ratio"),
    )


def fused_clusters(clusters: DataFrame, fused: bool = True) -> DataFrame:
    """The rows of clusters that have, or lack, a fused entity."""
    has = F.max("fused_id").over(Window.partitionBy("cluster_id")).isNotNull()
    return clusters.withColumn("_f", has).where("_f" if fused else "not _f").drop("_f")


def dataset_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_distinct("split").alias("num_splits"), F.count("*").alias("total_pairs"))


def ground_truth(pairs: DataFrame, order: str = "confidence") -> DataFrame:
    """(id1, id2, is_match): one label a pair, that of the largest ``order`` value."""
    known = pairs.where("is_match is not null")
    return known.groupBy("id1", "id2").agg(F.max_by("is_match", F.struct(order, "is_match")).alias("is_match"))


def pair_entities(pairs: DataFrame) -> DataFrame:
    """(split, entity): distinct members of a split's pairs."""
    return pairs.select("split", F.explode(F.array("id1", "id2")).alias("entity")).distinct()


def fuse(members: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row a cluster from (cluster_id, attributes...); rules max, min, concat or average by attribute."""
    how = {
        "max": F.max, "min": F.min, "average": F.avg,
        "concat": lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), "|"),
    }
    for r in rules.values():
        if r not in how:
            raise ValueError(f"unknown rule {r!r}")
    return members.groupBy("cluster_id").agg(*[how[r](c).alias(c) for c, r in rules.items()])


def split_of(key: Column, ratios: dict[str, float], seed: int | str = 42) -> Column:
    """The split of a key by its digest: stable under any partitioning; ratios add up to 1."""
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must add up to 1")
    at = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("long")
    out, total = None, 0.0
    names = list(ratios)
    for n in names[:-1]:
        total += ratios[n]
        test = at < round(total * 2**32)
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def gold_clusters(entities: DataFrame, record: str = "recId") -> DataFrame:
    """(record, members): entities that stand for the same record, sorted."""
    return entities.groupBy(_key(record).alias("record")).agg(F.sort_array(F.collect_list("identifier")).alias("members"))


def class_labels(membership: DataFrame, entities: DataFrame, record: str = "recId") -> DataFrame:
    """(entity_id, cluster_id, label): 1 for the entities of a cluster's most frequent record; ties to the smallest record."""
    rows = membership.join(entities.select(F.col("identifier").alias("entity_id"), _key(record).alias("record")), "entity_id")
    counts = rows.groupBy("cluster_id", "record").agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster_id").agg(F.max_by("record", F.struct("n", F.lit(0))).alias("_any"), F.min(F.struct((-F.col("n")).alias("m"), F.col("record").alias("r"))).alias("b"))
    return rows.join(best.select("cluster_id", F.col("b.r").alias("best")), "cluster_id").select("entity_id", "cluster_id", F.col("record").eqNullSafe(F.col("best")).cast("int").alias("label"))


def linkage_matches(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (id1, id2) of the ground truth both of whose entities exist."""
    a, b = left.select(F.col("identifier").alias("id1")), right.select(F.col("identifier").alias("id2"))
    return truth.select("id1", "id2").join(a, "id1", "left_semi").join(b, "id2", "left_semi").select("id1", "id2")


def overlap(base: DataFrame, other: DataFrame) -> DataFrame:
    """(total, shared, ratio): the share of the distinct rows of ``base`` that ``other`` has too."""
    shared = base.distinct().intersect(other).agg(F.count("*").alias("shared"))
    both = base.distinct().agg(F.count("*").alias("total")).crossJoin(shared)
    return both.select("total", "shared", F.try_divide(F.col("shared").cast("double"), F.col("total")).alias("ratio"))
