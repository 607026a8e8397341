import random
from collections import defaultdict

import pyarrow as pa
import pytest

from kgloom.llm import substring
from kgloom.llm.words import buffers, char_positions, word_spans

M = 50


def brute(rows, m=M):
    """Runs of windows that occur before, from a dictionary of all windows."""
    at = defaultdict(list)
    for doc, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        data, off = buffers(pa.array([text]))
        _, s, e, h = word_spans(data, off)
        place = char_positions(data)
        h = h.tolist()
        for i in range(len(h) - m + 1):
            at[tuple(h[i : i + m])].append((doc, i, int(place[s[i]]), int(place[e[i + m - 1]])))
    later = set()
    for places in at.values():
        places.sort()
        later |= {(d, places[0][0], i, s, e) for d, i, s, e in places[1:] if (d, i) != places[0][:2]}
    out, held = [], None
    for d, src, i, s, e in sorted(later):
        if held and held[:2] == (d, src) and i - held[2] <= 1:
            held = (d, src, i, held[3], e, held[5])
        else:
            if held:
                out.append(held)
            held = (d, src, i, s, e, i)
    if held:
        out.append(held)
    return sorted((d, s, e, i - i0 + m, src) for d, src, i, s, e, i0 in out)


def made(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["é", "ö", "x", "yy"]) + str(rng.randrange(500))
    shared = [[word() for _ in range(k)] for k in (49, 50, 51, 60, 200)]
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(0, len(words) + 1)
            words[k:k] = rng.choice(shared)
        out.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return out + [(90, "tick tock " * 80), (91, None), (92, ""), (None, out[0][1]), (3, out[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_all_passages_against_brute_force(spark, seed, limit):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in substring.repeated_passages(df, broadcast_keys=limit).collect())
    assert got == brute(rows) and got


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_windows_of_very_many_places_are_spread_to_the_same_result(spark, limit, monkeypatch):
    monkeypatch.setattr(substring, "_SAMPLE", 2)
    common = " ".join(f"c{i}" for i in range(70))
    rows = made(3) + [(1000 + i, f"own{i} " + common + f" end{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, hot = [], substring._hot
    monkeypatch.setattr(substring, "_hot", lambda *a: found.append(hot(*a)) or found[-1])
    got = sorted(tuple(r) for r in substring.repeated_passages(df, broadcast_keys=limit, hot_places=20).collect())
    assert got == brute(rows) and len(found[0].value) >= 21


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(8)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(200_000))
    rows = [(1, long + " " + shared), (2, "x " + shared), (3, shared + " " + long[:2000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substring.repeated_passages(df).collect()) == brute(rows)


def test_more_shards_than_ranges(spark, monkeypatch):
    from kgloom.llm import counting

    rows = made(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for module in (counting, substring):
        monkeypatch.setattr(module, "PARTITIONS", 2)
    monkeypatch.setattr(substring, "shard_count", lambda d: 16)
    assert sorted(tuple(r) for r in substring.repeated_passages(df).collect()) == brute(rows)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in substring.repeated_passages(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table_and_clashing_columns(spark):
    assert substring.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5), (2, text.upper(), 6)], "doc_id long, text string, start int")
    assert [tuple(r) for r in substring.repeated_passages(df).collect()] == [(2, 0, len(text), 60, 1)]
