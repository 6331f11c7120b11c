"""Join values to the intervals of a table that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators.lookup import fits_broadcast, lookup_join

# The level of intervals without an end.
_ENDLESS = 1 << 16


def _level(lower: Column, upper: Column) -> Column:
    """Least power of two that is at least as long as the interval; endless ones have their own."""
    length = upper - lower
    endless = (F.abs(lower) == float("inf")) | (F.abs(upper) == float("inf"))
    return F.when(endless, _ENDLESS).otherwise(F.ceil(F.log2(length)).cast("int"))


def _bin(value: Column, level: Column) -> Column:
    """Number of the piece of the level's width that holds a value: after its start, up to its end."""
    return F.when(level == _ENDLESS, F.lit(0.0)).otherwise(F.ceil(value / F.pow(F.lit(2.0), level)).cast("double"))


def in_ranges(
    df: DataFrame,
    value: str,
    ranges: DataFrame,
    lower: str = "lower",
    upper: str = "upper",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Every row of ``df`` with every row of ``ranges`` for which ``lower < value <= upper``.

    Intervals may overlap and have any length. Each is known by the power of two that is as long
    as it, and reaches into at most two, or by rounding three, pieces of that width; a value lies
    in one piece of each width that occurs. So both sides meet in an equality join, and the bounds
    decide. Small ``ranges``, measured, are broadcast, others are shuffled and skewed pieces split.

    NULL and NaN values, NULL bounds and empty intervals hold nothing. An infinite bound is open.
    """
    if set(df.columns) & set(ranges.columns):
        raise ValueError("both tables have columns " + ", ".join(sorted(set(df.columns) & set(ranges.columns))))
    low, high = F.col(lower).cast("double"), F.col(upper).cast("double")
    known = ranges.filter((low < high) & ~F.isnan(low) & ~F.isnan(high)).withColumn("_level", _level(low, high))
    last = _bin(high, F.col("_level"))
    # The bin of the lower bound itself may be shared: values just above it lie there or in the next.
    first = _bin(low, F.col("_level"))
    steps = F.transform(F.sequence(F.lit(0), (last - first).cast("int")), lambda i: first + i)
    pieces = known.withColumn("_bin", F.explode(steps))
    # Levels are exponents of doubles: some two thousand at most, and as a rule a few.
    levels = sorted(r["_level"] for r in known.select("_level").distinct().collect())
    number = F.col(value).cast("double")
    some = df.filter(number.isNotNull() & ~F.isnan(number))
    each = some.withColumn("_level", F.explode(F.lit(levels or [_ENDLESS]))).withColumn("_bin", _bin(number, F.col("_level")))
    small = fits_broadcast(pieces, broadcast_bytes)
    met = lookup_join(each, pieces, ["_level", "_bin"], small=small)
    return met.filter((number > low) & (number <= high)).drop("_level", "_bin")
