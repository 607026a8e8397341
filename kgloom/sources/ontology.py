"""Ontologies in Turtle: their triples, classes, parents and labels."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.literals import literal_lang, literal_value
from kgloom.vocab import DBO, RDF_TYPE, RDFS_LABEL

OWL_CLASS, SUBCLASS = "<http://www.w3.org/2002/07/owl#Class>", "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
_TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<directive>@prefix\b|@base\b|PREFIX\b|BASE\b)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w.\-]*[\w\-])
    |(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?))
    |(?P<name>(?:[A-Za-z][\w\-]*(?:\.[\w\-]+)*)?:(?:[\w:%\-]|\.(?=[\w:%\-]))*|a\b|true\b|false\b)
    |(?P<sign>[.;,\[\]()])""",
    re.X | re.S,
)
_XSD, _RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse_turtle(text: str, scope: str = "") -> list[tuple[str, str, str, bool]]:
    """(s, p, o, isLiteral) of a Turtle document; ValueError names the place that isn't Turtle.

    Terms are written as in N-Triples. Blank nodes without a name are numbered
    within ``scope``, collections become lists of them.
    """
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {at}: {text[at : at + 40]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m.group(), at))
        at = m.end()
    prefixes, base, out, fresh, i = {}, "", [], 0, 0

    def take(*want):
        nonlocal i
        if i >= len(tokens) or (want and tokens[i][1] not in want):
            where = tokens[i][2] if i < len(tokens) else len(text)
            raise ValueError(f"no Turtle at {where}: {text[where : where + 40]!r}")
        i += 1
        return tokens[i - 1]

    def peek():
        return tokens[i][1] if i < len(tokens) else None

    def blank():
        nonlocal fresh
        fresh += 1
        return f"_:{scope}b{fresh}"

    def full(iri):
        return iri if re.match(r"<[A-Za-z][\w+.\-]*:", iri) else f"<{base}{iri[1:]}"

    def address():
        kind, value, where = take()
        if kind != "iri":
            raise ValueError(f"no IRI at {where}: {value!r}")
        return full(value)[1:-1]

    def emit(s, p, o):
        out.append((s, p, o, o.startswith('"')))

    def term():
        kind, value, where = take()
        if kind == "iri":
            return full(value)
        if kind == "blank":
            return f"_:{scope}{value[2:]}"
        if kind == "name":
            if value == "a":
                return f"<{_RDF}type>"
            if value in ("true", "false"):
                return f'"{value}"^^<{_XSD}boolean>'
            prefix, _, local = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix {prefix!r} at {where}")
            return f"<{prefixes[prefix]}{local}>"
        if kind == "number":
            return f'"{value}"^^<{_XSD}{"double" if "e" in value.lower() else "decimal" if "." in value else "integer"}>'
        if kind == "text":
            body = value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1]
            body = re.sub(r'(?<!\\)((?:\\\\)*)"', r'\1\\"', body).replace("\n", "\\n").replace("\r", "\\r")
            if peek() == "^^":
                take("^^")
                return f'"{body}"^^{term()}'
            return f'"{body}"{take()[1]}' if i < len(tokens) and tokens[i][0] == "lang" else f'"{body}"'
        if value == "[":
            node = blank()
            if peek() != "]":
                properties(node)
            take("]")
            return node
        if value == "(":
            items = []
            while peek() != ")":
                items.append(term())
            take(")")
            nodes = [blank() for _ in items] + [f"<{_RDF}nil>"]
            for k, x in enumerate(items):
                emit(nodes[k], f"<{_RDF}first>", x)
                emit(nodes[k], f"<{_RDF}rest>", nodes[k + 1])
            return nodes[0]
        raise ValueError(f"no Turtle at {where}: {value!r}")

    def properties(subject):
        while True:
            p = term()
            while True:
                emit(subject, p, term())
                if peek() != ",":
                    break
                take(",")
            while peek() == ";":
                take(";")
            if peek() in (".", "]", None):
                return

    while i < len(tokens):
        if tokens[i][0] == "directive":
            what = take()[1]
            if "prefix" in what.lower():
                kind, name, where = take()
                if kind != "name" or not name.endswith(":"):
                    raise ValueError(f"no prefix at {where}: {name!r}")
                prefixes[name[:-1]] = address()
            else:
                base = address()
            if what.startswith("@"):
                take(".")
            continue
        own = peek() == "["
        subject = term()
        if not (own and peek() == "."):
            properties(subject)
        take(".")
    return out


def read_turtle(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Triples of Turtle files, each parsed whole by one task; blank nodes of several files stay apart."""
    kind = pa.schema([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("isLiteral", pa.bool_())])

    def run(batches):
        for b in batches:
            for text, scope in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = parse_turtle(text, scope)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    files = spark.read.text(path, wholetext=True).select("value", F.concat(F.lit("f"), F.substring(F.md5(F.col("_metadata.file_path")), F.lit(1), F.lit(8))).alias("scope"))
    return files.mapInArrow(run, "s string, p string, o string, isLiteral boolean")


def ontology(triples: DataFrame, namespace: str = DBO) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes (class), parents (class, parent), labels (class, label)) by local name.

    Classes are the owl:Class subjects of the namespace; parents lie in it too;
    labels are English or have no language.
    """
    own = lambda c: F.col(c).startswith(f"<{namespace}")
    local = lambda c: F.regexp_replace(F.substring(c, len(namespace) + 2, 1 << 20), ">$", "")
    classes = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL_CLASS) & own("s")).select("s").distinct()
    mine = triples.join(classes, "s", "left_semi")
    parents = mine.where((F.col("p") == SUBCLASS) & own("o")).select(local("s").alias("class"), local("o").alias("parent")).distinct()
    lang = literal_lang(F.col("o"))
    labels = mine.where((F.col("p") == RDFS_LABEL) & F.col("isLiteral") & (lang.isNull() | lang.isin("", "en"))).select(local("s").alias("class"), literal_value(F.col("o")).alias("label"))
    return classes.select(local("s").alias("class")), parents, labels
