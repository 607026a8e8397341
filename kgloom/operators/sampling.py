"""Entity samples in an order that depends on the seed and the ids only.

Where random order is asked for, rows go by md5(seed|id), which doesn't change
with partitioning and can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.triples import is_type
from kgloom.plans.durable import cut


def shuffled(seed: int | str, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def _check(n: int, related: int) -> None:
    if n < 0 or related < 0:
        raise ValueError("sizes can't be negative")


def edges(triples: DataFrame, directed: bool) -> DataFrame:
    """Distinct (e, neighbour) over triples with a resource as object, without loops."""
    out = triples.where(~F.col("isLiteral") & (F.col("s") != F.col("o"))).select(F.col("s").alias("e"), F.col("o").alias("neighbour"))
    return (out if directed else out.union(out.select("neighbour", "e"))).distinct()


def _neighbours(triples: DataFrame, seeds: DataFrame, related: int, seed: int, directed: bool) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("e").orderBy(shuffled(seed, F.col("e"), F.col("neighbour")), "neighbour"))
    near = edges(triples, directed).join(seeds.select(F.col("s").alias("e")), "e", "left_semi")
    return near.withColumn("r", rank).where(F.col("r") <= related).select(F.col("neighbour").alias("s"))


def _selected(triples: DataFrame, seeds: DataFrame, related: int, seed: int, directed: bool) -> DataFrame:
    if related:
        seeds = seeds.union(_neighbours(triples, seeds, related, seed, directed)).distinct()
    return triples.join(seeds, "s", "left_semi")


def sample_global(triples: DataFrame, n: int, related: int = 0, seed: int = 42) -> DataFrame:
    """The triples of n entities and of up to ``related`` neighbours of each, in either direction."""
    _check(n, related)
    seeds = triples.select("s").distinct().orderBy(shuffled(seed, F.col("s")), "s").limit(n)
    return _selected(triples, seeds, related, seed, directed=False)


def sample_all_types(triples: DataFrame, n: int, related: int = 0, seed: int = 42) -> DataFrame:
    """The triples of up to n entities of every type and of up to ``related`` of the objects they lead to."""
    _check(n, related)
    typed = triples.where(is_type()).select("s", F.col("o").alias("type")).distinct()
    rank = F.row_number().over(Window.partitionBy("type").orderBy(shuffled(seed, F.col("s")), "s"))
    seeds = typed.withColumn("r", rank).where(F.col("r") <= n).select("s").distinct()
    return _selected(triples, seeds, related, seed, directed=True)


def sample_type_targets(triples: DataFrame, targets: dict[str, int], related: int = 0, seed: int = 42) -> DataFrame:
    """Triples of a sample that reaches a number of entities for each type, the rarest type first.

    What earlier types (and their neighbours) brought in counts for the later
    ones. A type's turn depends on the selection so far, so there is one round
    a target; the selection is checkpointed after each.
    """
    if any(n < 0 for n in targets.values()):
        raise ValueError("sizes can't be negative")
    typed = cut(triples.where(is_type() & F.col("o").isin(list(targets))).select("s", F.col("o").alias("type")).distinct())
    order = [r["type"] for r in typed.groupBy("type").count().orderBy("count", "type").collect()]
    chosen = typed.select("s").limit(0)
    for i, kind in enumerate(order):
        own = typed.where(F.col("type") == kind).select("s")
        missing = targets[kind] - own.join(chosen, "s", "left_semi").count()
        if missing <= 0:
            continue
        new = own.join(chosen, "s", "left_anti").orderBy(shuffled(seed + i, F.col("s")), "s").limit(missing)
        if related > 0:
            new = cut(new)
            new = new.union(_neighbours(triples, new, related, seed + 1000 + i, directed=False))
        chosen = cut(chosen.union(new).distinct())
    return triples.join(chosen, "s", "left_semi")


def sample_coverage(triples: DataFrame, n: int, related: int = 0, seed: int = 42) -> DataFrame:
    """The triples of entities that cover every predicate: up to n of each predicate's subjects, and their neighbours."""
    _check(n, related)
    of = triples.select("s", "p").distinct()
    rank = F.row_number().over(Window.partitionBy("p").orderBy(shuffled(seed, F.col("s")), "s"))
    seeds = of.withColumn("r", rank).where(F.col("r") <= n).select("s").distinct()
    return _selected(triples, seeds, related, seed, directed=True)


def overlapping_subsets(ids: DataFrame, key: str, k: int, size: int, overlap: float, seed: int = 42) -> DataFrame:
    """(subset, key): k subsets of ``size`` ids that share ``overlap`` x size of them and nothing else."""
    core = round(size * overlap)
    own = size - core
    ranked = ids.select(F.col(key)).distinct().orderBy(shuffled(seed, F.col(key).cast("string")), key).limit(core + k * own)
    # at most core + k x own ids are left, a number the caller asks for
    ranked = ranked.withColumn("r", F.row_number().over(Window.orderBy(shuffled(seed, F.col(key).cast("string")), key)) - 1)
    subset = F.when(F.col("r") < core, F.sequence(F.lit(0), F.lit(k - 1))).otherwise(F.array(F.floor((F.col("r") - core) / max(1, own)).cast("int")))
    return ranked.select(F.explode(subset).alias("subset"), key)
