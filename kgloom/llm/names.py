"""Column handling shared by the operators.

Input columns are found without regard to case. Columns that an operator
doesn't need are either left out or carried through; one whose name equals an
output column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(df: DataFrame, name: str) -> Column:
    """The column, or a ValueError that names what there is."""
    for c in df.columns:
        if c.lower() == name.lower():
            return df[f"`{c}`"]
    raise ValueError(f"no column {name!r}; there are {df.columns}")


def others(df: DataFrame, taken: list[str]) -> list[str]:
    """Input columns whose names don't clash with ``taken``."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def carried(df: DataFrame, alias: str = "_row") -> Column:
    """All columns of ``df`` as one struct, out of the way of any other name."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(alias)


def unpacked(df: DataFrame, columns: list[str], alias: str = "_row") -> list[Column]:
    """The columns of the struct that ``carried`` made, by their own names."""
    return [F.col(alias)[c].alias(c) for c in columns]
