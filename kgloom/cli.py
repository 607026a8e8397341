"""Command line: python -m kgloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from kgloom.operators import sampling, statistics as st, temporal as tp, triples as tr
from kgloom.operators.schema_graph import schema_graph
from kgloom.operators.serialize import nquads, rdf_star, reification
from kgloom.sources import text


def term(given: str) -> str:
    """An IRI in brackets; ``URI*`` and bare words become prefixes."""
    g = given.strip()
    if not g:
        raise argparse.ArgumentTypeError("an empty term")
    if g.startswith("<"):
        return g if g.endswith((">", "*")) else g + "*"
    if "://" in g:
        return f"<{g}" if g.endswith("*") else f"<{g}>"
    return f"<{g.rstrip('*')}*"


def iri(given: str) -> str:
    """A class IRI in brackets."""
    g = given.strip()
    if not g or g.endswith("*"):
        raise argparse.ArgumentTypeError(f"{given!r} is no IRI")
    return g if g.startswith("<") and g.endswith(">") else f"<{g.strip('<>')}>"


def target(given: str) -> tuple[str, int]:
    """``IRI=N``: so many entities of a type."""
    name, _, n = given.rpartition("=")
    if not name or not n.isdigit():
        raise argparse.ArgumentTypeError(f"{given!r} isn't IRI=N")
    return iri(name), int(n)


def size(given: str) -> int:
    if not given.isdigit():
        raise argparse.ArgumentTypeError(f"{given!r} isn't a size")
    return int(given)


def unique(items: list) -> list:
    return list(dict.fromkeys(items))


#: What ``stats`` computes over facts, by name.
STATISTICS = {
    "unique-windows": st.unique_windows, "triples-per-subject": st.triples_per_subject, "revisions-per-page": st.revisions_per_page, "changes-per-predicate": st.changes_per_predicate,
    "start-revisions": st.revisions_over_time, "end-revisions": lambda f: st.revisions_over_time(f, True), "start-triples": st.triples_over_time, "end-triples": lambda f: st.triples_over_time(f, True),
    "changes": st.changes_over_time, "in-degree": lambda f: st.degree_frequency(f, True), "in-degree-spread": lambda f: st.degree_distribution(f, True),
    "out-degree": lambda f: st.degree_frequency(f, False), "out-degree-spread": lambda f: st.degree_distribution(f, False), "span": st.activity_span, "span-by-year": lambda f: st.activity_span(f, True),
    "subjects": lambda f: st.parts_over_time(f, "subject"), "predicates": lambda f: st.parts_over_time(f, "predicate"), "objects": lambda f: st.parts_over_time(f, "object"),
    "snapshots": lambda f: st.snapshot_statistics(f, ["yearly", "monthly", "instant"]), "summary": st.summary, "days": st.window_days, "hours": st.window_hours, "properties": st.property_changes,
}


def _selected(t: DataFrame, a: argparse.Namespace) -> DataFrame:
    modes = [m for m in ("type", "classes", "sample", "sample_types", "target") if getattr(a, m)]
    if len(modes) > 1:
        raise SystemExit(f"only one of {', '.join(modes)} at a time")
    related = a.related if a.related is not None else 0 if a.sample_types else 5
    if a.type:
        for kind in unique(a.type):
            t = tr.with_types(t, [kind])
    elif a.classes:
        t = tr.class_subgraph(t, unique(a.classes))
    elif a.sample:
        t = sampling.sample_global(t, a.sample, related, a.seed)
    elif a.sample_types:
        t = sampling.sample_all_types(t, a.sample_types, related, a.seed)
    elif a.target:
        t = sampling.sample_type_targets(t, dict(a.target), related, a.seed)
    if a.only_types:
        t = tr.only_types(t, unique(a.only_types))
    return tr.connected_objects(t) if a.connected else t


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgloom")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("select", help="triples of some entities, as N-Triples")
    s.add_argument("--type", action="append", type=iri, help="subjects with this type; again: with all of them")
    s.add_argument("--classes", action="append", type=iri, help="the subgraph among instances of these classes")
    s.add_argument("--sample", type=size, help="so many entities")
    s.add_argument("--sample-types", type=size, help="so many entities of every type")
    s.add_argument("--target", action="append", type=target, help="IRI=N, rarest type first")
    s.add_argument("--related", type=size, help="neighbours taken along with each entity")
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--only-types", action="append", type=iri, help="drop other type statements")
    s.add_argument("--connected", action="store_true", help="drop objects that are no subject")
    g = sub.add_parser("schema-graph", help="types and relations with counts, as CSV")
    g.add_argument("--property", action="append", type=term)
    e = sub.add_parser("stats", help="statistics over facts, each as CSV under its name")
    e.add_argument("--name", action="append", choices=list(STATISTICS), required=True)
    n = sub.add_parser("snapshot", help="facts valid at a time, as Parquet")
    n.add_argument("--at", type=int, required=True, help="epoch seconds")
    n.add_argument("--closed", action="store_true")
    w = sub.add_parser("serialize", help="facts as text")
    w.add_argument("--form", choices=["nquads", "reification", "rdf-star"], default="nquads")
    for x in (s, g, e, n, w):
        x.add_argument("--kind", choices=["parquet", "json", "csv"], default="parquet", help="format of facts")
        x.add_argument("input")
        x.add_argument("output")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kgloom").getOrCreate()
    if a.command == "select":
        text.write_ntriples(_selected(text.read_ntriples(spark, a.input), a), a.output)
    elif a.command == "schema-graph":
        text.write_report(schema_graph(text.read_ntriples(spark, a.input), unique(a.property or [])), a.output, "schema_graph")
    else:
        facts = text.read_facts(spark, a.input, a.kind)
        if a.command == "stats":
            for name in unique(a.name):
                text.write_report(STATISTICS[name](facts), a.output, name)
        elif a.command == "snapshot":
            tp.snapshot(facts, a.at, a.closed).write.parquet(a.output)
        else:
            {"nquads": nquads, "reification": reification, "rdf-star": rdf_star}[a.form](facts).write.text(a.output)


if __name__ == "__main__":
    main(sys.argv[1:])
