"""Columns that are computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row, however often later columns use it.

    A generator of one row keeps the optimizer from copying the expression into each of its uses.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once. For rare branches: it is interpreted, not compiled."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
