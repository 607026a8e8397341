import numpy as np
import pytest

from kgloom.llm import quality
from tests.llm.brute import line_rules

HEAD = "Read  MORE here"


def made():
    out = [(i, f"body {i} has words enough\n{HEAD if i % 2 else HEAD.lower() + ' '}\n\nend {i}", "h") for i in range(30)]
    out += [(100 + i, f"{HEAD}\nx{i}", "h") for i in range(3)]  # depleted
    out += [(200 + i, f"{HEAD}\nother host {i}", "g") for i in range(8)]  # below the limit there
    out += [(300 + i, "the same text\nin many copies", "h") for i in range(40)]  # copies are one document
    return out + [(400, None, "h"), (401, "", "h"), (402, " \n\t", "h"), (403, f"null host\n{HEAD}", None), (None, f"no id but words\n{HEAD}", "h"), (1, out[1][1], "h"), (404, "long " * 100_000 + f"\n{HEAD}", "h")]


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_against_plain_rules(spark, limit):
    rows = made()
    df = spark.createDataFrame([(i, t, s, len(t or ""), 9) for i, t, s in rows], "doc_id long, text string, source string, n_chars long, key int").repartition(3)
    got = quality.remove_frequent_lines(df, broadcast_lines=limit)
    assert got.columns == df.columns
    want = line_rules([{"doc_id": i, "text": t, "source": s, "n_chars": len(t or "")} for i, t, s in rows])
    assert sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in got.collect()), key=repr) == sorted(((d["doc_id"], d["text"], d["source"], d["n_chars"]) for d in want), key=repr)
    assert not any(r.doc_id in (100, 101, 102) for r in got.collect())
    assert quality.remove_frequent_lines(df.where("false")).count() == 0


def test_lines_are_lowered_as_in_sql_and_long_texts_take_their_time(spark):
    import time

    import pyarrow as pa

    assert quality.normal_lines("a  b\t c \n\n x") == ["a b c", "", "x"]
    assert quality.solid(" a\tb\n\r\fc ") == 3
    many = "\n".join(f"line {i % 2 and i}" for i in range(64_000))
    known = set(quality.line_keys(["line 0"], quality.host_seed("h")).tolist())
    t = time.time()
    got = quality._rest(pa.array(["h"] * 2), pa.array([many, None]), 0.1, lambda i, k: np.isin(k, list(known))).to_pylist()
    assert time.time() - t < 2
    assert got[0]["text"] == "\n".join(x for x in many.split("\n") if x != "line 0") and got[0]["length"] == len(got[0]["text"]) and not got[1]["keep"]


def test_hosts_and_nulls_have_keys_of_their_own():
    a, b, c = (quality.line_keys(["x", ""], quality.host_seed(h)).tolist() for h in ("h", "", None))
    assert len({a[0], b[0], c[0]}) == 3 and a[1] == b[1] == c[1] == 0
