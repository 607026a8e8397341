import argparse

import pytest

from kgloom import cli
from kgloom.vocab import RDF_TYPE


def test_terms():
    assert [cli.term(x) for x in ("http://a/b", "http://a/b*", "<http://a>", "dbo", "dbo*")] == ["<http://a/b>", "<http://a/b*", "<http://a>", "<dbo*", "<dbo*"]
    assert cli.iri(" http://a ") == "<http://a>" and cli.target("http://a=3") == ("<http://a>", 3)
    for bad in (lambda: cli.term(" "), lambda: cli.iri("a*"), lambda: cli.target("http://a"), lambda: cli.size("-1")):
        with pytest.raises(argparse.ArgumentTypeError):
            bad()


def test_select_and_report(spark, tmp_path, monkeypatch):
    (tmp_path / "in.nt").write_text(f"<x> {RDF_TYPE} <A> .\n<x> <p> <y> .\n<y> <p> <gone> .\n")
    cli.main(["select", "--type", "A", "--connected", f"{tmp_path}/in.nt", f"{tmp_path}/out"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == [f"<x> {RDF_TYPE} <A> ."]
    cli.main(["schema-graph", "--property", "<p>", f"{tmp_path}/in.nt", f"{tmp_path}/rep"])
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/rep/schema_graph", header=True).collect()) == [("<A>", "<p>", "Untyped", "1"), ("Untyped", "<p>", "Untyped", "1")]
    with pytest.raises(SystemExit):
        cli.main(["select", "--type", "A", "--sample", "3", f"{tmp_path}/in.nt", f"{tmp_path}/o2"])
    facts = spark.createDataFrame([("h", "r", "t", "1", "2", 5, 9)], "head string, rel string, tail string, rStart string, rEnd string, tStart long, tEnd long")
    facts.write.parquet(f"{tmp_path}/facts")
    cli.main(["stats", "--name", "summary", "--name", "hours", f"{tmp_path}/facts", f"{tmp_path}/stats"])
    assert spark.read.csv(f"{tmp_path}/stats/summary", header=True).first().triples == "1"
    cli.main(["snapshot", "--at", "5", f"{tmp_path}/facts", f"{tmp_path}/snap"])
    cli.main(["serialize", f"{tmp_path}/facts", f"{tmp_path}/nq"])
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 1 and spark.read.text(f"{tmp_path}/nq").count() == 3
