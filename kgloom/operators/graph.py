"""Similarity graphs between entities of several sources, and class hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.components import connected_components
from kgloom.plans.durable import cut


def similarity_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, sim) with src < dst, one row a pair: the largest similarity of the repeated ones."""
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim")
    return ends.groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def loaded_edges(edges: DataFrame, vertices: DataFrame, key: str = "identifier") -> DataFrame:
    """Edges both of whose ends exist."""
    for end in ("src", "dst"):
        edges = edges.join(vertices.select(F.col(key).alias(end)), end, "left_semi")
    return edges.select("src", "dst", "sim")


def clusters(edges: DataFrame) -> DataFrame:
    """(entity_id, cluster_id): connected components, named by their smallest member; single vertices have none."""
    return connected_components(edges).select(F.col("vertex").alias("entity_id"), F.col("component").alias("cluster_id"))


def filter_links(edges: DataFrame, sources: DataFrame, normal: bool = False) -> DataFrame:
    """Strong links, and with ``normal`` also normal ones, as (src, dst, sim, strength).

    For each entity and each source the links to the most similar neighbours
    of that source are maximal, ties included. A link that is maximal from both
    ends is strong, from one end normal, from none weak. ``sources``:
    (identifier, source).
    """
    known = similarity_graph(edges)
    both = known.select(F.col("src").alias("a"), F.col("dst").alias("b"), "sim").union(known.select("dst", "src", "sim"))
    both = both.join(sources.select(F.col("identifier").alias("b"), "source"), "b")
    top = both.groupBy("a", "source").agg(F.max("sim").alias("top"))
    best = both.join(top, ["a", "source"]).where(F.col("sim") == F.col("top"))
    seen = best.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "sim").agg(F.count("*").alias("n"))
    out = seen.select("src", "dst", "sim", F.when(F.col("n") == 2, "strong").otherwise("normal").alias("strength"))
    return out if normal else out.where("strength = 'strong'")


def source_matrix(entities: DataFrame) -> DataFrame:
    """(source, attribute, position): each source's attributes, numbered from 0 by name."""
    names = entities.select("source", F.explode(F.map_keys("properties")).alias("attribute")).distinct()
    return names.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("attribute")) - 1)


def anchor_distances(parents: DataFrame, anchors: DataFrame) -> DataFrame:
    """(class, domain, distance): fewest steps up from a class to an anchor of a domain, 0 for the anchor.

    ``parents``: (class, parent); ``anchors``: (domain, class). Walks down from
    the anchors, one level of the hierarchy a round; only newly reached classes
    go on, so cycles end by themselves.
    """
    parents = parents.select("class", "parent").distinct()
    reached = cut(anchors.select("class", "domain", F.lit(0).alias("distance")).distinct())
    edge, step = reached, 0
    while True:
        step += 1
        following = edge.select(F.col("class").alias("parent"), "domain").join(parents, "parent").select("class", "domain").distinct()
        edge = cut(following.join(reached, ["class", "domain"], "left_anti").withColumn("distance", F.lit(step)))
        if edge.isEmpty():
            return reached
        reached = cut(reached.union(edge))


def hierarchy_lines(parents: DataFrame, members: DataFrame, most: int = 10_000_000) -> DataFrame:
    """(domain, path, depth): each class of a domain below the roots of its domain, alphabetical by path.

    ``members``: (class, domain). Roots have no parent within the domain; a
    class with several parents shows under each; a class already on the path is
    not entered again; classes that no root leads to come last, at depth 0.
    Many parents make many paths: with more than ``most`` it is a ValueError.
    """
    within = parents.join(members, "class").join(members.select(F.col("class").alias("parent"), "domain"), ["parent", "domain"]).select("domain", "parent", "class").distinct()
    roots = members.join(within.select("class", "domain").distinct(), ["class", "domain"], "left_anti")
    level = cut(roots.select("domain", "class", F.array("class").alias("path")))
    found, paths = level, 0
    while n := level.count():
        paths += n
        if paths > most:
            raise ValueError(f"more than {most} paths in the hierarchy")
        below = level.select("domain", F.col("class").alias("parent"), "path").join(within, ["domain", "parent"])
        below = below.where(~F.array_contains("path", F.col("class")))
        level = cut(below.select("domain", "class", F.concat("path", F.array("class")).alias("path")))
        found = found.union(level)
    rest = members.join(found.select("class", "domain").distinct(), ["class", "domain"], "left_anti").select("domain", F.concat(F.lit("~"), F.col("class")).alias("path"), F.lit(0).alias("depth"))
    return found.select("domain", F.array_join("path", "/").alias("path"), (F.size("path") - 1).alias("depth")).union(rest)


# clusters as a table (cluster_id, entity_id)


def create_cluster(members: DataFrame, cluster_id: str, entities: list[str]) -> DataFrame:
    """The table with a new cluster; ValueError if its name is taken."""
    if members.where(F.col("cluster_id") == cluster_id).limit(1).count():
        raise ValueError(f"cluster {cluster_id!r} exists")
    new = members.sparkSession.createDataFrame([(cluster_id, e) for e in dict.fromkeys(entities)], "cluster_id string, entity_id string")
    return members.unionByName(new)


def add_members(members: DataFrame, cluster_id: str, entities: list[str]) -> DataFrame:
    new = members.sparkSession.createDataFrame([(cluster_id, e) for e in dict.fromkeys(entities)], "cluster_id string, entity_id string")
    return members.unionByName(new.join(members, ["cluster_id", "entity_id"], "left_anti"))


def remove_members(members: DataFrame, cluster_id: str, entities: list[str]) -> DataFrame:
    return members.where(~((F.col("cluster_id") == cluster_id) & F.col("entity_id").isin(entities)))


def delete_cluster(members: DataFrame, cluster_id: str) -> DataFrame:
    return members.where(F.col("cluster_id") != cluster_id)


def merge_clusters(members: DataFrame, merges: DataFrame) -> DataFrame:
    """Clusters renamed by (cluster_id, into), each entity once."""
    renamed = members.join(merges, "cluster_id", "left").select(F.coalesce("into", "cluster_id").alias("cluster_id"), "entity_id")
    return renamed.distinct()


def vertex_windows(facts: DataFrame) -> DataFrame:
    """(head, tStart, tEnd, properties): literal facts of a head and window, sorted and joined by bars."""
    rows = facts.where(F.col("tail").startswith('"'))
    return rows.groupBy("head", "tStart", "tEnd").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "rel", "tail"))), "|").alias("properties"))


def edge_windows(facts: DataFrame) -> DataFrame:
    """(rel, tStart, tEnd, links): facts between resources of a relation and window, sorted and joined by bars."""
    rows = facts.where(~F.col("tail").startswith('"'))
    return rows.groupBy("rel", "tStart", "tEnd").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(">", "head", "tail"))), "|").alias("links"))
