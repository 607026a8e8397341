"""Vector best-fit packing of token sequences into training bins.

A bin has three capacities: tokens, documents and attention cost (the sum of the
squared lengths of its pieces). A text longer than a bin can hold is cut into
pieces, none of it is dropped. Pieces, longest first, go to the open bin that
has room under every constraint and scores best, or else open a new bin.

Pieces are dealt to groups by a hash, about ``group_pieces`` documents to a
group, and each group is packed on its own, in lanes of at most ``group_pieces``
pieces, so that a task's time grows with its pieces and not with their square;
only ids and lengths move. What a lane wastes is its last few bins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names
from kgloom.plans.durable import written

BIN_TOKENS, BIN_DOCS, BIN_ATTENTION = 2048, 16, 2048 * 2048 // 2
GROUP_PIECES = 8192


def word_tokens(text: Column) -> Column:
    """Runs of non-blank characters; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0))


def best_fit(lengths: np.ndarray, tokens: int, docs: int, attention: int, score: str = "dot", weights=(1.0, 1.0, 1.0)) -> np.ndarray:
    """The bin of each piece, pieces given longest first.

    ``dot``: the largest weighted dot product of the piece's needs and the bin's
    residuals, both as shares of the capacities. ``norm``: the smallest weighted
    squared norm of what would be left. Ties go to the bin opened first.
    """
    cap = np.array([tokens, docs, attention], float)
    w = np.asarray(weights, float)
    need = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
    left = np.empty((64, 3))
    opened = 0  # open bins are left[:opened]; names maps them to bins
    names_ = np.empty(64, np.int64)
    out = np.empty(len(lengths), np.int64)
    bins = 0
    smallest = need[-1] if len(need) else None
    for i, v in enumerate(need):
        room = left[:opened]
        fits = np.flatnonzero((room >= v).all(1))
        if len(fits):
            if score == "dot":
                k = fits[np.argmax((room[fits] / cap) @ (w * v / cap))]
            elif score == "norm":
                k = fits[np.argmin((((room[fits] - v) / cap) ** 2) @ w)]
            else:
                raise ValueError(f"unknown score {score!r}")
        else:
            if opened == len(left):
                left, names_ = np.concatenate([left, np.empty_like(left)]), np.concatenate([names_, np.empty_like(names_)])
            left[opened], names_[opened] = cap, bins
            k, opened, bins = opened, opened + 1, bins + 1
        left[k] -= v
        out[i] = names_[k]
        if (left[k] < smallest).any():  # not even the shortest piece fits any more
            left[k : opened - 1], names_[k : opened - 1] = left[k + 1 : opened].copy(), names_[k + 1 : opened].copy()
            opened -= 1
    return out


def _runs(docs: DataFrame, size: int) -> tuple[DataFrame, Column]:
    """(``docs`` as a file scan, the number of each row's run of ``size`` rows, in the order of the files' names)."""
    try:
        files = docs.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    except AnalysisException:  # not a file scan: there is no _metadata
        docs = written(docs, "pack-input")
        files = docs.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    # a file's runs are numbered from its place among the files; no file has 2^24 runs
    order = docs.sparkSession.createDataFrame([(r.f, i) for i, r in enumerate(sorted(files))], "_pack_file string, _pack_order long")
    docs = docs.select("*", F.col("_metadata.file_path").alias("_pack_at"), F.floor(F.col("_metadata.row_index") / size).cast("long").alias("_pack_run"))
    docs = docs.join(F.broadcast(order), F.col("_pack_at") == F.col("_pack_file"))
    return docs, F.shiftleft("_pack_order", 24) + F.col("_pack_run")


def pack(
    docs: DataFrame,
    bin_tokens: int = BIN_TOKENS,
    bin_docs: int = BIN_DOCS,
    bin_attention: int = BIN_ATTENTION,
    score: str = "dot",
    weights=(1.0, 1.0, 1.0),
    tokens: Column | None = None,
    group_pieces: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    in_order: bool = False,
) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, bin_group, bin, bin_position) of every piece.

    ``tokens``: the token count of a row; by default ``word_tokens``. Pieces are
    as long as both the token and the attention capacity allow, with the default
    capacities 1,448 tokens, the root of the attention capacity. A null, empty or
    blank text has no tokens and no piece. Rows with a null id are packed, with
    a null id in the result; repeated rows are packed each. Ties between equally
    long pieces go by id and piece. Other columns are ignored; an empty table
    gives no rows.

    With ``in_order`` the groups are runs of ``group_pieces`` rows as they lie in
    the table's files, numbered in the order of the files' names, so that bins of
    successive groups follow the order of the documents; a DataFrame that doesn't
    read files is first written to the shared folder.
    """
    if min(bin_tokens, bin_docs, bin_attention) < 1:
        raise ValueError("capacities must be positive")
    longest = min(bin_tokens, math.isqrt(bin_attention))
    group_pieces = group_pieces or GROUP_PIECES
    group = F.lit(None).cast("long")
    if in_order:
        docs, group = _runs(docs, group_pieces)
    n = tokens if tokens is not None else word_tokens(names.col(docs, text))
    rows = docs.select(names.col(docs, doc_id).cast("long").alias("doc_id"), n.cast("long").alias("n"), group.alias("g")).where("n > 0")
    pieces = rows.select("doc_id", "n", "g", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest).cast("long"))).alias("at", "piece"))
    pieces = pieces.select("g", "doc_id", "piece", (F.col("piece") * longest).alias("start_token"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens"))
    # as many groups as the rows ask for; the count reads no column
    groups = 1 if in_order else max(1, math.ceil(docs.count() / group_pieces))
    pieces = pieces.withColumn("bin_group", F.coalesce("g", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(groups)))).drop("g")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lanes, length, opened = -(-len(pdf) // group_pieces), pdf["n_tokens"].to_numpy(), 0
        bins = np.empty(len(pdf), np.int64)
        for k in range(lanes):  # every lanes-th piece, so that lanes are alike
            mine = best_fit(length[k::lanes], bin_tokens, bin_docs, bin_attention, score, weights) + opened
            bins[k::lanes], opened = mine, int(mine.max()) + 1
        pdf["bin"] = bins
        pdf["bin_position"] = pdf.groupby("bin").cumcount()
        return pdf

    return pieces.groupBy("bin_group").applyInPandas(one, "doc_id long, piece long, start_token long, n_tokens long, bin_group long, bin long, bin_position long")
