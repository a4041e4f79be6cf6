"""Arrays to rows without evaluating the array twice.

An inner ``explode`` makes the optimizer infer ``size(array) > 0`` and push it below the projection that computes the
array, so a costly array would be computed for the filter and again for the rows, with everything it is built from
substituted into the filter. The outer form infers nothing, and the test on its output stays above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, array: Column | str, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` columns and one row per non-null array element."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column | str, pos: str, name: str, *keep: str | Column) -> DataFrame:
    """As :func:`explode_rows`, with the element position (from 0)."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a costly computed condition, evaluated once per row after the columns it reads."""
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_keep"))
    return marked.filter(F.col("_keep").isNotNull()).drop("_keep")
