"""Averages of averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(df: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """Mean of each value per key and day, over the rows that have one."""
    return df.groupBy(*keys, day).agg(*[F.avg(v).alias(v) for v in values])


def mean_of_daily_means(df: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """Mean over days of the daily means: a day counts once however many rows it has."""
    daily = daily_means(df, keys, day, values)
    return daily.groupBy(*keys).agg(*[F.avg(v).alias(f"avg_{v}") for v in values])
