"""Pfair mixing of sources to target weights.

Block j (1, 2, ...) of a source with weight w is released at slot floor((j-1)/w)
and due by slot ceil(j/w). At each slot the released block with the earliest
deadline goes next. After every slot each source's number of blocks differs from
weight x slots by less than one block. When a source has no block left, the
others go on by themselves.

Weights are whole numbers that add up to the period, so the schedule repeats
after it: one period is drawn up by the driver (its length is a parameter, not
the size of the data) and each source's blocks are numbered in parallel. The
order of the documents within a source is that of md5(seed|doc_id); ranks come
from counts per hash bucket, so no source is sorted by one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm import names

OTHERS = "*"


def pfair_period(weights: dict[str, int]) -> list[str]:
    """The sources of one period's slots; as many slots as the weights' sum.

    Equal deadlines go to the smaller name. Weights must be whole and positive.
    """
    if any(w != int(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights must be whole and positive")
    period = sum(weights.values())
    waiting = sorted((0, -(-period // w), s, 1) for s, w in weights.items())
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        slots.append(s)
        if j < weights[s]:
            heapq.heappush(waiting, (j * period // weights[s], -(-(j + 1) * period // weights[s]), s, j + 1))
    return slots


def slots_to_fill(period: list[str], blocks: dict[str, int]) -> int:
    """How many slots can be filled in turn before a source lacks its block."""
    best = None
    for s in set(period):
        at = [i for i, x in enumerate(period) if x == s]
        turn, k = divmod(blocks.get(s, 0), len(at))
        first = turn * len(period) + at[k]
        best = first if best is None else min(best, first)
    return best or 0


def phases(weights: dict[str, int], blocks: dict[str, int], go_on: bool = True) -> list[tuple[int, int, list[str], dict[str, int]]]:
    """(first slot, slots, period, blocks of each source used before) of each phase.

    A phase ends where a source would have to give a block that it hasn't. The
    sources that have blocks left then start a schedule of their own, in which
    they keep their proportions; without ``go_on`` the first phase is the last.
    """
    out, start, used = [], 0, dict.fromkeys(weights, 0)
    live = {s: w for s, w in weights.items() if blocks.get(s, 0) > 0}
    while live:
        period = pfair_period(live)
        total = slots_to_fill(period, {s: blocks[s] - used[s] for s in live})
        out.append((start, total, period, {s: used[s] for s in live}))
        for i, s in enumerate(period):
            used[s] += (total - i + len(period) - 1) // len(period) if total > i else 0
        start += total
        live = {s: w for s, w in live.items() if blocks[s] > used[s]} if go_on else {}
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    block_docs: int = 1,
    seed: str = "mix",
    bucket_rows: int = 1 << 16,
    source: str = "source",
    doc_id: str = "doc_id",
    go_on: bool = True,
    broadcast_buckets: int = 1 << 20,
) -> DataFrame:
    """The documents of the mixture with their ``mix_source``, ``mix_position`` and ``mix_phase``.

    ``weights``: whole numbers by source; ``"*"`` stands for all sources without
    a weight of their own, null among them, taken together. Without ``"*"`` they
    are left out. The schedule of all weights ends where a source would have to
    give a block that it hasn't: phase 0. The other sources go on in phase 1 in
    their own proportions, and so on until all are used up, so that every
    document of a source with a weight comes, and comes once; the last block of a
    source may be short, which leaves a gap in the positions. With ``go_on``
    false, phase 0 of whole blocks is all there is, and the rest is left out.
    ``mix_position`` counts from 0 in mixture order.

    Rows that share an id are ordered by a hash of all their columns; equal
    rows are interchangeable. A null id counts as the text "null". Texts, also
    null, empty and very long ones, are carried along. The buckets' first ranks
    are broadcast where there are at most ``broadcast_buckets``, else joined by a
    shuffle, to the same result. Input columns named
    mix_source, mix_position or mix_phase give way. An empty table gives no rows.
    """
    if block_docs < 1:
        raise ValueError("block_docs must be positive")
    src, key = names.col(docs, source).cast("string"), names.col(docs, doc_id).cast("string")
    listed = [s for s in weights if s != OTHERS]
    cls = F.when(src.isin(listed), src) if listed else F.lit(None).cast("string")
    if OTHERS in weights:
        cls = F.coalesce(cls, F.lit(OTHERS))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key, F.lit("null"))))
    rows = docs.select(cls.alias("c"), digest.alias("k"), F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns if _hashable(docs, c)]).alias("tie"), names.carried(docs)).where("c is not null")
    sizes = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    full = {s: -(-n // block_docs) if go_on else n // block_docs for s, n in sizes.items()}
    plan = phases(weights, full, go_on)
    out = names.others(docs, ["mix_source", "mix_position", "mix_phase"])
    if not plan:
        return rows.where("false").select(*names.unpacked(rows, out), F.col("c").alias("mix_source"), F.lit(0).cast("long").alias("mix_position"), F.lit(0).alias("mix_phase"))
    # (source, phase): its blocks there, its weight, the phase's first slot and period; and the slots of one period
    spans, slots, quota = [], [], {}
    for k, (start, total, period, used) in enumerate(plan):
        nth: dict[str, int] = {}
        for i, s in enumerate(period):
            slots.append((s, k, nth.get(s, 0), i))
            nth[s] = nth.get(s, 0) + 1
        for s, w in nth.items():
            here = sum((total - i + len(period) - 1) // len(period) for i, x in enumerate(period) if x == s and total > i)
            spans.append((s, k, used[s], used[s] + here, w, start, len(period)))
            quota[s] = used[s] + here
    # buckets by leading hash digits, so that ranks add up over counts
    digits = 1
    while 16**digits * bucket_rows < max(sizes.values()) and digits < 7:
        digits += 1
    rows = rows.where(F.col("c").isin(list(quota))).withColumn("b", F.substring("k", 1, digits))
    spark = docs.sparkSession
    counts = rows.groupBy("c", "b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = spark.createDataFrame([(s, q * block_docs) for s, q in quota.items()], "c string, quota long")
    starts = counts.withColumn("before", before).drop("count").join(F.broadcast(asked), "c").where("before < quota")
    # at most 16**digits rows a source, which is the number of rows over bucket_rows
    rows = rows.join(F.broadcast(starts) if 16**digits * len(quota) <= broadcast_buckets else starts, ["c", "b"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("c", "b").orderBy("k", "tie")) - 1
    rows = rows.withColumn("rank", rank).where("rank < quota").withColumn("block", F.floor(F.col("rank") / block_docs).cast("long"))
    spans = F.broadcast(spark.createDataFrame(spans, "c string, phase int, lo long, hi long, w long, start long, period long")).alias("p")
    rows = rows.alias("r").join(spans, (F.col("r.c") == F.col("p.c")) & (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi"))).drop(F.col("p.c"))
    rows = rows.withColumn("turn", F.floor((F.col("block") - F.col("lo")) / F.col("w")).cast("long")).withColumn("nth", (F.col("block") - F.col("lo")) % F.col("w"))
    slots = F.broadcast(spark.createDataFrame(slots, "c string, phase int, nth long, slot long"))
    position = (F.col("start") + F.col("turn") * F.col("period") + F.col("slot")) * block_docs + F.col("rank") % block_docs
    return rows.join(slots, ["c", "phase", "nth"]).select(*names.unpacked(rows, out), F.col("c").alias("mix_source"), position.cast("long").alias("mix_position"), F.col("phase").alias("mix_phase"))


def in_order(docs: DataFrame, weights: dict[str, int], part_rows: int = 1 << 14, source: str = "source", doc_id: str = "doc_id", **kw) -> DataFrame:
    """The documents of ``mix`` with their own columns only, laid out in mixture order.

    Partition 0 holds the first ``part_rows`` positions in order, partition 1 the
    next and so on, so that a table written from it keeps the order in its files.
    Sources without a weight come in no order of their own, as there are none
    when ``weights`` has ``"*"``.
    """
    low = [c.lower() for c in docs.columns]
    for c in (source, doc_id):
        names.col(docs, c)
    plain = docs.toDF(*[f"c{i}" for i in range(len(low))])  # so that no column gives way
    mixed = mix(plain, weights, source=f"c{low.index(source.lower())}", doc_id=f"c{low.index(doc_id.lower())}", **kw)
    parts = max(1, -(-docs.count() // part_rows))
    at = F.least(F.floor(F.col("mix_position") / part_rows), F.lit(parts - 1)).cast("int")
    return mixed.repartitionById(parts, at).sortWithinPartitions("mix_position").select(*plain.columns).toDF(*docs.columns)


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString() and "variant" not in df.schema[name].dataType.simpleString()
