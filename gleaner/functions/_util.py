from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def lit_of(v) -> Column:
    """Accept a Column or a Python literal."""
    return v if isinstance(v, Column) else F.lit(v)


def get0(arr) -> Column:
    """First array element, NULL for an empty/NULL array (never throws)."""
    return F.get(col_of(arr), 0)


def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` (a Column -> Column
    function). Composed column helpers otherwise copy a sub-expression into
    every place it is used, which repeats the work per row and can make the
    generated code too large to compile."""
    return F.get(F.transform(F.array(expr), fn), 0)
