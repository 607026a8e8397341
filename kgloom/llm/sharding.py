"""A uniform shuffle into shards of exact sizes.

How many rows go from each input block to each shard is a random matrix with
given row and column sums, whose law is multivariate hypergeometric. It is drawn
exactly, by splitting: at a node of the tree over the blocks the shards' open
places are split between the left and right half. Each split has its own seed,
so that any task can draw its block's row by itself, and draws the same one when
it runs again. A block's rows are then permuted, the first of them dealt to
shard 0, the next to shard 1 and so on, exchanged once, and permuted within
their shard.

A shard larger than ``part_rows`` is drawn as several parts of exact sizes, each
permuted by a task of its own; since the parts' rows are uniform too, so is the
shard's order, one part after another. The number of parts follows the number of
rows, so a larger table is another draw.

The seed and the blocks' rows determine the result: blocks count by the order of
their files' names, and neither names nor folders enter the draw.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.plans.durable import written

_LIMIT = 10**9 - 1


def _big(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """Hypergeometric beyond numpy's limit of 10**9, by inversion outwards from the mode."""
    if good + bad <= _LIMIT:
        return int(rng.hypergeometric(good, bad, take)) if take and good else 0
    lo, hi = max(0, take - bad), min(take, good)
    mode = min(hi, max(lo, (take + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def log_p(k):
        return lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(take - k + 1) - lg(bad - take + k + 1) - lg(good + bad + 1) + lg(take + 1) + lg(good + bad - take + 1)

    u, p = rng.random(), math.exp(log_p(mode))
    up = down = mode
    p_up = p_down = p
    u -= p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (take - up) / ((up + 1) * (bad - take + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - take + down) / ((good - down + 1) * (take - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def split_places(rng: np.random.Generator, places: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` draws without replacement fall on each of ``places``."""
    size = 1 << max(0, (len(places) - 1).bit_length())
    tree = [np.concatenate([places, np.zeros(size - len(places), np.int64)])]
    while len(tree[-1]) > 1:
        tree.append(tree[-1].reshape(-1, 2).sum(1))
    got = np.array([take], np.int64)
    for level in reversed(tree[:-1]):
        good, bad = level[0::2], level[1::2]
        if int((good + bad).max(initial=0)) <= _LIMIT:
            left = rng.hypergeometric(good, bad, got)
        else:
            left = np.array([_big(rng, int(g), int(b), int(t)) for g, b, t in zip(good, bad, got)])
        got = np.column_stack([left, got - left]).ravel()
    return got[: len(places)]


def matrix_row(sizes: np.ndarray, places: np.ndarray, block: int, seed: int) -> np.ndarray:
    """Row ``block`` of the communication matrix of blocks of ``sizes`` rows."""
    total = np.r_[0, np.cumsum(sizes)]
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_places(np.random.default_rng([seed, 0, lo, hi]), places, int(total[mid] - total[lo]))
        lo, hi, places = (lo, mid, left) if block < mid else (mid, hi, places - left)
    return places


def even(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by at most one, the larger ones first."""
    out = np.full(parts, total // parts, np.int64)
    out[: total % parts] += 1
    return out


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, block_rows: int = 1 << 18, part_rows: int = 1 << 15) -> DataFrame:
    """All rows with their ``shard`` (from 0) and ``shard_position`` (from 0).

    Shard sizes differ by at most one, the larger ones first. Blocks are the
    ranges of ``block_rows`` rows of each input file; a DataFrame that doesn't
    read files is first written to the shared folder, so that a task that runs
    again sees the same rows in the same place. Values don't matter: nulls,
    repeated rows and long texts are rows like any other. Input columns named
    shard or shard_position give way. With fewer rows than shards the last
    shards are empty; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    where = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    at = [where[0].alias("f"), F.floor(where[1] / block_rows).cast("long").alias("b"), (where[1] % block_rows).alias("r")]

    def count(df: DataFrame) -> list:
        return df.select(*at).groupBy("f", "b").agg(F.count("*").alias("n"), F.max("r").alias("last")).collect()

    try:
        found = count(docs)
    except AnalysisException:  # not a file scan: there is no _metadata
        found = None
    if found is None or any(r["n"] != r["last"] + 1 for r in found):  # or one that leaves rows out
        docs = written(docs, "shard-input")
        found = count(docs)
    out = names.others(docs, ["shard", "shard_position"])
    blocks = sorted((r["f"], r["b"], r["n"]) for r in found)
    sizes = np.array([n for *_, n in blocks], np.int64)
    rows = int(sizes.sum())
    parts = max(1, math.ceil(rows / shards / part_rows))
    of_shard = even(rows, shards)
    places = np.concatenate([even(int(n), parts) for n in of_shard])
    before = np.cumsum(places) - places - np.repeat(np.cumsum(of_shard) - of_shard, parts)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(({(f, b): i for i, (f, b, _) in enumerate(blocks)}, sizes, places))
    drawn: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def draw(i: int):
        if (seed, i) not in drawn:
            _, n, p = held.value
            drawn.clear()  # rows come block by block
            drawn[seed, i] = np.random.default_rng([seed, 1, i]).permutation(int(n[i])), np.cumsum(matrix_row(n, p, i, seed))
        return drawn[seed, i]

    @F.arrow_udf("struct<part:int,block:int>")
    def part_of(f: pa.Array, b: pa.Array, row: pa.Array) -> pa.Array:
        number = held.value[0]
        f = f.dictionary_encode()
        code, b, row = f.indices.to_numpy(), b.to_numpy(), row.to_numpy()
        result, block = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
        for c, k in {*zip(code.tolist(), b.tolist())}:
            mine = (code == c) & (b == k)
            block[mine] = i = number[f.dictionary[c].as_py(), k]
            order, ends = draw(i)
            result[mine] = np.searchsorted(ends, order[row[mine] % block_rows], "right")
        return pa.StructArray.from_arrays([pa.array(result), pa.array(block)], ["part", "block"])

    placed = docs.select(*[docs[f"`{c}`"] for c in out], *[c.alias(n) for c, n in zip(where, ("_kg_file", "_kg_row"))])
    placed = placed.withColumn("_kg_at", part_of("_kg_file", F.floor(F.col("_kg_row") / block_rows).cast("long"), "_kg_row"))
    placed = placed.select(*[placed[f"`{c}`"] for c in out], F.col("_kg_at.part").alias("_kg_part"), F.col("_kg_at.block").alias("_kg_block"), "_kg_row")
    again = F.xxhash64(F.lit(seed), F.col("_kg_block"), F.col("_kg_row"))
    rank = F.row_number().over(Window.partitionBy("_kg_part").orderBy(again, "_kg_block", "_kg_row")) - 1
    if parts > 1:
        start = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(before)], "_kg_part int, _kg_start long"))
        placed = placed.withColumn("_kg_rank", rank).join(start, "_kg_part")
        rank = F.col("_kg_start") + F.col("_kg_rank")
    placed = placed.withColumn("shard_position", rank.cast("long")).withColumn("shard", F.floor(F.col("_kg_part") / parts).cast("int"))
    return placed.select(*[placed[f"`{c}`"] for c in out], "shard", "shard_position")
