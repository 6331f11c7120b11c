"""Nearest-rank (discrete) percentile: a value of the data, never interpolated.

The value at position ``ceil(n * q)`` in ascending order. NULL values are
counted in ``n`` and sort first, so a group with many NULLs can have a NULL
percentile; ``percentile_disc`` skips NULLs and would answer differently.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators.settle import settle


def rank_within(
    df: DataFrame, keys: list[str], value: str, tie_break: list[str] | None = None
) -> DataFrame:
    """Add ``rn`` (ascending, NULLs first) and ``cnt`` (all rows) per key.

    One task sorts each group: for groups of a known bound, such as the days of
    a period. Both windows share one exchange and one sort.
    """
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(F.col(value).asc_nulls_first(), *(tie_break or []))
    return df.withColumns(
        {"rn": F.row_number().over(ordered), "cnt": F.count(F.lit(1)).over(group)}
    )


def rank_position(count: Column, q: float) -> Column:
    """Position of the nearest-rank percentile among ``count`` rows, in exact arithmetic.

    The first one for ``q`` = 0.
    """
    exact = F.ceil(count * F.lit(Decimal(str(q)))).cast("long")
    return F.greatest(exact, F.lit(1).cast("long"))


def value_at_rank(value: str, q: float) -> Column:
    """Aggregate over ranked rows: the value at the percentile's position."""
    return F.max(F.when(F.col("rn") == rank_position(F.col("cnt"), q), F.col(value)))


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Exact percentile per key for groups of any size, with one read of the input.

    Equal values of a key are counted first, on the map side, so a frequent value (or NULL)
    is one row. The counts are dealt into sorted ranges of (key, value), so a key with many
    values lies in several of them, and kept. Their sums per range tell which range of a key
    holds the wanted position, and only that part of the key is ranked: never more than a
    range, and ranges are as many as there are shuffle partitions.
    """
    counted = (
        df.select(F.struct(*keys).alias("_key"), F.col(value).alias("_value"))
        .groupBy("_key", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranges, _ = settle(
        counted.repartitionByRange("_key", F.col("_value").asc_nulls_first()).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    upwards = Window.partitionBy("_key").orderBy("_range")
    sums = (
        ranges.groupBy("_key", "_range")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_upto", F.sum("_size").over(upwards))
        .withColumn(
            "_position", rank_position(F.sum("_size").over(Window.partitionBy("_key")), q)
        )
    )
    before = F.col("_upto") - F.col("_size")
    target = sums.filter(
        (before < F.col("_position")) & (F.col("_position") <= F.col("_upto"))
    ).select("_key", "_range", (F.col("_position") - before).alias("_rank"))
    rising = Window.partitionBy("_key", "_range").orderBy(F.col("_value").asc_nulls_first())
    reached = (
        ranges.join(target, ["_key", "_range"])
        .withColumn("_reached", F.sum("_n").over(rising))
        .filter((F.col("_reached") >= F.col("_rank")) & (F.col("_reached") - F.col("_n") < F.col("_rank")))
    )
    return reached.select("_key.*", F.col("_value").alias("percentile"))
