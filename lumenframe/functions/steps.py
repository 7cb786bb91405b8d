"""Formulas as lists of named SQL expressions that Catalyst and other SQL engines read alike.

A formula is [(name, expression), ...]; an expression may use the names before it. Number literals carry an
exponent so that they are doubles, not decimals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]


def num(x: float) -> str:
    """A double literal."""
    return f"({x!r}e0)" if "e" not in repr(float(x)) else f"({x!r})"


def applied(df: DataFrame, steps: Steps) -> DataFrame:
    """df with a column for each step; columns of the same name are replaced."""
    for name, expression in steps:
        df = df.withColumn(name, F.expr(expression))
    return df


def as_sql(base: str, steps: Steps, columns: str = "*") -> str:
    """The same as nested selects over the query `base`."""
    for name, expression in steps:
        base = f"SELECT *, {expression} AS {name} FROM ({base})"
    return f"SELECT {columns} FROM ({base})"


def renamed(steps: Steps, names: dict[str, str]) -> Steps:
    """Steps with whole-word names replaced, inside expressions too."""
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")
    swap = lambda s: pattern.sub(lambda m: names[m[1]], s)
    return [(swap(n), swap(e)) for n, e in steps]
