"""Exploding without evaluating the array twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keys: Sequence[str], array: str | Column, idx: str, value: str) -> DataFrame:
    """One row per element with its position; an empty or null array yields none.

    A plain explode lets the optimizer infer a filter on the array, push it to the scan and so compute
    the whole array a second time. The outer form with a filter on the position keeps it to once.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(idx, value)).filter(F.col(idx).isNotNull())


def settle(df: DataFrame, *cols: str) -> DataFrame:
    """Compute the columns once, however many filters and references follow."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*cols))))


def let(value: Column, body) -> Column:
    """`body(value)` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
