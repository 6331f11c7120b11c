"""Calendar labels and range predicates on epoch-second clocks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.params import ROLLING_LABEL, TimeWindow

# Partition column of the stored fact tables: UTC date of ``clock``.
DATE_PARTITION = "dt"


def local_day(clock: Column, tz: str) -> Column:
    """Calendar date of an epoch-second clock in ``tz``, whatever the session zone."""
    if tz == "UTC":
        return F.date_from_unix_date(F.floor(clock / 86400).cast("int"))
    # Zone offsets are whole minutes, so minutes are enough to find the date,
    # and they keep the integer argument of timestampadd in range.
    minutes = F.floor(clock / 60).cast("int")
    utc = F.timestamp_add("MINUTE", minutes, F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc))


def day_label(day: Column) -> Column:
    """``YYYY-MM-DD`` text of a date."""
    return day.cast("string")


def period_label(day: Column, window: TimeWindow) -> Column:
    """Period a day belongs to: one fixed label when rolling, else ``YYYY-MM``."""
    if window.rolling:
        return F.lit(ROLLING_LABEL)
    return F.date_format(F.to_date(day), "yyyy-MM")


def clock_range(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows with ``start <= clock < end``; either bound may be open.

    Tables stored by UTC date get the matching partition predicate as well, so
    whole directories outside the range are never listed.
    """
    by_date = DATE_PARTITION in df.columns
    if start is not None:
        df = df.filter(F.col("clock") >= start)
        if by_date:
            df = df.filter(F.col(DATE_PARTITION) >= F.lit(_utc_date(start)))
    if end is not None:
        df = df.filter(F.col("clock") < end)
        if by_date:
            df = df.filter(F.col(DATE_PARTITION) <= F.lit(_utc_date(end - 1)))
    return df


def _utc_date(clock: int):
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=clock)).date()
