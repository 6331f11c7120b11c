"""Line up two sides of a measurement that arrive as rows of one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.measures import share_pct


def pivot_sides(
    df: DataFrame,
    keys: list[str],
    first: Column,
    second: Column,
    value: Column,
    agg: Callable[[Column], Column],
) -> DataFrame:
    """One row per key: ``first`` and ``second`` side values and their row counts.

    Reads the input once; the two sides never meet in a join.
    """
    return df.groupBy(*keys).agg(
        agg(F.when(first, value)).alias("first"),
        agg(F.when(second, value)).alias("second"),
        F.count_if(first).alias("n_first"),
        F.count_if(second).alias("n_second"),
    )


def paired_ratio(
    df: DataFrame,
    keys: list[str],
    first: Column,
    second: Column,
    value: Column,
) -> DataFrame:
    """Per key that has both sides: both sums and the first as a share of the two."""
    both = pivot_sides(df, keys, first, second, value, F.sum).filter(
        (F.col("n_first") > 0) & (F.col("n_second") > 0)
    )
    share = share_pct(F.col("first"), F.col("second"))
    return both.select(*keys, "first", "second", share.alias("ratio_pct"))
