"""Schemas of the tables that operators take, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

_TYPES: dict[str, DataType] = {
    "string": StringType(), "boolean": BooleanType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "map<string,string>": MapType(StringType(), StringType()),
}


def _schema(text: str) -> StructType:
    """A schema from ``name type, ...`` that needs no session."""
    out = StructType()
    for field in text.split(", "):
        name, kind = field.split(" ")
        out.add(name, _TYPES[kind])
    return out


TRIPLES = _schema("s string, p string, o string, isLiteral boolean")
FACTS = _schema("head string, rel string, tail string, rStart string, rEnd string, tStart bigint, tEnd bigint")
REVISIONS = _schema("id bigint, pageid bigint, timestamp string, namespace int")
VERSIONS = _schema("pid bigint, rid bigint, ts bigint, ok boolean")
ENTITIES = _schema("identifier string, source string, properties map<string,string>")
EDGES = _schema("src string, dst string, sim double")
PAIRS = _schema("split string, id1 string, id2 string, is_match boolean, confidence double")


def require(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the schema's columns in order; ValueError unless it has exactly these."""
    have, want = set(df.columns), set(schema.names)
    if have != want:
        raise ValueError(f"missing columns {sorted(want - have)}, unknown columns {sorted(have - want)}")
    return df.select(*schema.names)
