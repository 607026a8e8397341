"""The pipeline against a plain version of all its stages, and its SQL queries against DuckDB."""

import re

import pytest

import corpus_pipeline
from kgloom.llm import packing, queries
from tests.llm import brute
from tests.oracle import compare, duck


def packed(docs):
    """(doc_id, piece, start, length, bin) of documents of one group."""
    longest, pieces = 1448, []
    for d in docs:
        n = len(re.findall(r"[^ \t\n\r\f]+", d["text"]))
        pieces += [(min(longest, n - a), d["doc_id"], k, a) for k, a in enumerate(range(0, n, longest))]
    pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1], p[2]))
    bins = brute.bins([p[0] for p in pieces], packing.BIN_TOKENS, packing.BIN_DOCS, packing.BIN_ATTENTION)
    return sorted((d, k, a, n, b) for (n, d, k, a), b in zip(pieces, bins))


def plain(docs):
    """The rows of the pipeline for a table of less than one group, but for the group's name."""
    docs = brute.one_of_each_text(brute.line_rules(docs))
    gone = brute.near_groups(docs)
    return packed([d for d, *_ in brute.mixture([d for d in docs if d["doc_id"] not in gone], queries.MIX_WEIGHTS)])


def test_run_against_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((*tuple(r)[:4], r.bin) for r in got) == plain(docs) and got and len({r.bin_group for r in got}) == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, path, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS bin", "1 AS mix_position", "2 AS key", "3 AS _row", "4 AS digest", "'p' AS piece")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


ROWS = [(1, None, "src0"), (2, "", "src0"), (3, " \n\t", "a"), (4, "one text\nof two lines", "a"), (5, "one text\nof two lines", None), (4, "one text\nof two lines", "a"), (6, "?", "a"), (7, "?", "a"), (8, "word", "src1"), (9, "long " * 200_000 + "end", "b"), (10, "tie a", "src2"), (11, "tie b", "src2")]


def test_odd_documents(spark, tmp_path):
    d = made(spark, tmp_path / "t", ROWS, extra=True)
    got = corpus_pipeline.run(spark, d).collect()
    want = plain([{"doc_id": i, "text": t, "source": s, "n_chars": len(t or "")} for i, t, s in ROWS])
    assert sorted((*tuple(r)[:4], r.bin) for r in got) == want and {r.doc_id for r in got} == {4, 6, 8, 9, 10, 11}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).dtypes == docs.dtypes


def test_empty_table(spark, tmp_path):
    d = made(spark, tmp_path / "t", [])
    assert corpus_pipeline.run(spark, d).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() == 0


def test_the_mixture_takes_effect(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    rows = [(i, f"text number {i} of its own " + " ".join(f"w{i}x{k}" for k in range(30)), "src0" if i % 10 == 0 else "other") for i in range(200)]
    d = made(spark, tmp_path / "t", rows)
    docs = [{"doc_id": i, "text": t, "source": s} for i, t, s in rows]
    groups = {}
    for r in corpus_pipeline.run(spark, d).collect():
        groups.setdefault(r.bin_group, set()).add(r.doc_id)
    order = [x["doc_id"] for x, *_ in brute.mixture(docs, queries.MIX_WEIGHTS)]
    assert [groups[g] for g in sorted(groups)] == [set(order[i : i + 20]) for i in range(0, 200, 20)]


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mix", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, duck(sf), queries.queries()[name], queries.oracle_sql()[name], sf) is None


def test_all_eleven_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
