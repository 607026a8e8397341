import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kgloom.llm import packing
from tests.llm.brute import bins


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_against_plain_search(seed):
    rng = random.Random(seed)
    n = sorted((rng.randrange(1, 300) for _ in range(400)), reverse=True)
    assert packing.best_fit(np.array(n), 512, 5, 512 * 300).tolist() == bins(n, 512, 5, 512 * 300)


def check(rows, texts, tokens=packing.BIN_TOKENS, docs=packing.BIN_DOCS, attention=packing.BIN_ATTENTION):
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_bin[r.bin_group, r.bin].append(r)
        by_doc[r.doc_id].append(r)
    for held in by_bin.values():
        assert sum(r.n_tokens for r in held) <= tokens and len(held) <= docs and sum(r.n_tokens**2 for r in held) <= attention
        assert sorted(r.bin_position for r in held) == list(range(len(held)))
    for d, t in texts.items():
        size = len(re.findall(r"[^ \t\n\r\f]+", t or ""))
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.start_token for r in pieces] == [sum(x.n_tokens for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(r.n_tokens for r in pieces) == size
    return by_bin


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    for g in {r.bin_group for r in rows}:
        mine = sorted((r for r in rows if r.bin_group == g), key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        assert [r.bin for r in mine] == bins([r.n_tokens for r in mine], packing.BIN_TOKENS, packing.BIN_DOCS, packing.BIN_ATTENTION)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a " * 5000, 7), (2, None, 7), (3, " \n", 7), (None, "x y", 7), (4, "x y", 7), (4, "x y", 7)], "doc_id long, text string, bin int")
    rows = packing.pack(df).collect()
    check(rows, {1: "a " * 5000, 2: None, 3: ""})
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, bin_docs=0)
    assert packing.pack(df, score="norm").count() == len(rows)


def test_long_texts_null_ids_and_lanes(spark):
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([60_000, 1, 1448, 1449, 0, 30])] + [(None, "x " * (1 + i % 7)) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(df, group_pieces=50).collect()
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r.bin_group, r.bin].append(r)
    for held in by_bin.values():
        assert sum(r.n_tokens for r in held) <= packing.BIN_TOKENS and len(held) <= packing.BIN_DOCS and sum(r.n_tokens**2 for r in held) <= packing.BIN_ATTENTION
        assert sorted(r.bin_position for r in held) == list(range(len(held)))
    assert sum(r.doc_id is None for r in rows) == 300 and len({r.bin_group for r in rows if r.doc_id is None}) > 3
    assert sum(r.n_tokens for r in rows if r.doc_id == 0) == 60_000


def test_time_grows_with_the_pieces():
    import time

    t = time.time()
    packing.best_fit(np.sort(np.random.default_rng(1).integers(1, 1448, 8192))[::-1], packing.BIN_TOKENS, packing.BIN_DOCS, packing.BIN_ATTENTION)
    assert time.time() - t < 10


def test_groups_in_the_order_of_the_files(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 50))").alias("text"))
    df.repartitionById(4, (F.col("doc_id") / 250).cast("int")).sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "t"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "t")), group_pieces=100, in_order=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.bin_group].append(r.doc_id)
    runs = [sorted(by[g]) for g in sorted(by)]
    assert [x for run in runs for x in run] == list(range(1000)) and max(map(len, runs)) == 100
    check(rows, {r.doc_id: r.text for r in df.collect()})
    assert len(packing.pack(df, group_pieces=100, in_order=True).collect()) == 1000  # no files: written first
