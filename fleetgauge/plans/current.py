"""Present state from the raw samples: latest value, current usage, power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.clocks import clock_range
from fleetgauge.functions.measures import share_pct
from fleetgauge.operators.latest import latest
from fleetgauge.operators.lookup import sized, thinned
from fleetgauge.params import CURRENT_LOOKBACK, POWER_LOOKBACK
from fleetgauge.plans.usage import HOST, series_items


def recent_samples(history: DataFrame, wanted: DataFrame, as_of: int, small: bool) -> DataFrame:
    """Latest samples of the wanted items by one read: ``itemid, now, power``.

    ``now`` is the latest of the last six hours (a sample stamped after ``as_of`` counts),
    ``power`` of the last hour, strictly before ``as_of``. Both are ``clock, value``; ``power``
    is NULL where there is none. Beyond a broadcast most rows of other items are left out
    before they are grouped.
    """
    # Rows stored by host are grouped where they lie.
    keys = [HOST, "itemid"] if HOST in history.columns else ["itemid"]
    rows = clock_range(history, as_of - CURRENT_LOOKBACK).select(*keys, "clock", "value")
    if small:
        rows = rows.join(F.broadcast(wanted), "itemid", "left_semi")
    else:
        rows = thinned(rows, wanted, "itemid")
    clock = F.col("clock")
    last_hour = (clock >= as_of - POWER_LOOKBACK) & (clock < as_of)
    found = rows.groupBy(*keys).agg(
        latest("clock", "value").alias("now"),
        latest("clock", "value", last_hour).alias("power"),
    ).drop(HOST)
    return found if small else found.join(wanted, "itemid", "left_semi")


def current_samples(samples: DataFrame) -> DataFrame:
    """``itemid, clock, value`` of the six-hour look-back."""
    return samples.select("itemid", "now.clock", "now.value")


def power_samples(samples: DataFrame) -> DataFrame:
    """``itemid, clock, value`` of the one-hour look-back."""
    return samples.filter(F.col("power").isNotNull()).select("itemid", "power.clock", "power.value")


def latest_clock(samples: DataFrame) -> DataFrame:
    """``itemid, max_clock``."""
    return samples.select("itemid", F.col("clock").alias("max_clock"))


def current_sides(samples: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """``series_id`` with the latest clock and value of each side, NULL where there is none."""
    used = F.col("is_used")
    tagged = samples.join(sized(series_items(pairs), small), "itemid")
    return tagged.groupBy("series_id").agg(
        F.max(F.when(used, F.col("clock"))).alias("clock_used"),
        F.max(F.when(used, F.col("value"))).alias("value_used"),
        F.max(F.when(~used, F.col("clock"))).alias("clock_free"),
        F.max(F.when(~used, F.col("value"))).alias("value_free"),
    )


def pairs_with_sides(pairs: DataFrame, samples: DataFrame, small: bool) -> DataFrame:
    """All pairs, with the latest clock and value of each side where there is one."""
    sides = sized(current_sides(samples, pairs, small), small)
    return pairs.withColumn("series_id", F.col("used_itemid")).join(sides, "series_id", "left")


def current_usage(pairs: DataFrame, samples: DataFrame, small: bool) -> DataFrame:
    """Current usage per filesystem; NULL when a side has no sample or both are zero."""
    return pairs_with_sides(pairs, samples, small).select(
        "hostid",
        "vm_name",
        "partition_name",
        "clock_used",
        "clock_free",
        share_pct(F.col("value_used"), F.col("value_free")).alias("current_usage_pct"),
    )


def power_state(power_items: DataFrame, samples: DataFrame, small: bool) -> DataFrame:
    """``hostid, power_state``: one row per power item that has a recent sample."""
    return samples.join(sized(power_items, small), "itemid").select(
        "hostid", F.col("value").alias("power_state")
    )
