"""Samples and heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, ident: Column, seed: int = 0) -> DataFrame:
    """``n`` rows in a pseudo-random order of their ids: the same ones on every run and layout."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), ident.cast("string")).cast("binary"))
    return df.withColumn("_order", order).orderBy("_order").limit(n).drop("_order")


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``; all rows for no limit or one that is not positive."""
    return df if n is None or n <= 0 else df.orderBy(*order).limit(n)
