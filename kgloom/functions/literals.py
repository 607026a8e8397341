"""Column functions over RDF terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def literal_value(term: Column) -> Column:
    """The text between the quotes; null for anything but a literal."""
    return F.when(is_literal(term), F.regexp_extract(term, r'^"((?s:.*))"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?$', 1))


def literal_lang(term: Column) -> Column:
    """The language tag, or null."""
    tag = F.regexp_extract(term, r'^"(?s:.*)"@([A-Za-z0-9\-]+)$', 1)
    return F.when(tag != "", tag)


def literal_datatype(term: Column) -> Column:
    """The datatype IRI without brackets, or null."""
    kind = F.regexp_extract(term, r'^"(?s:.*)"\^\^<([^>]*)>$', 1)
    return F.when(kind != "", kind)


def literal_number(term: Column) -> Column:
    """The literal's value as a double, or null where it isn't a number."""
    return F.try_cast(literal_value(term), "double") if hasattr(F, "try_cast") else literal_value(term).try_cast("double")


def bracketed(iri: Column) -> Column:
    """An IRI in brackets; literals and bracketed terms as they are."""
    return F.when(is_literal(iri) | iri.startswith("<"), iri).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def bare(term: Column) -> Column:
    """An IRI without brackets; literals as they are."""
    return F.when(term.startswith("<") & term.endswith(">"), F.substring(term, F.lit(2), F.length(term) - 2)).otherwise(term)


def camel_tokens(name: Column) -> Column:
    """Lower-case tokens of a CamelCase or separated name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda t: t != "")


def any_property(predicate: Column, filters: list[str] | None = None) -> Column:
    """Whether a predicate passes: exact terms, or prefixes that end in ``*``; by default labels and ontology terms."""
    from kgloom.vocab import DBO, RDFS_LABEL

    wanted = [f.strip() for f in filters or [] if f.strip()]
    if not wanted:
        wanted = [RDFS_LABEL, f"<{DBO}*"]
    tests = [predicate.startswith(f[:-1]) if f.endswith("*") else predicate == f for f in wanted]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def instant(seconds: Column) -> Column:
    """Epoch seconds as a timestamp without time zone, whatever the session's zone; null for what no calendar holds."""
    safe = F.when(seconds.between(-62135596800, 253402300799), seconds)
    return F.timestamp_add("SECOND", safe, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch(moment: Column) -> Column:
    """A timestamp without time zone as epoch seconds."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment.cast("timestamp_ntz"))
