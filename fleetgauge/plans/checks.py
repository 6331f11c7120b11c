"""Data-quality checks: why a filesystem, a value or a state is missing from a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.measures import POWER_NAMES
from fleetgauge.functions.text import SIZE_KEY_REGEX
from fleetgauge.operators.bands import in_band
from fleetgauge.operators.lookup import sized
from fleetgauge.operators.nearest_rank import rank_within, value_at_rank
from fleetgauge.params import BANDS, TimeWindow
from fleetgauge.plans.current import pairs_with_sides
from fleetgauge.plans.items import SIZE_ROLES, has_any_role, size_items
from fleetgauge.plans.stages import Stages
from fleetgauge.plans.usage import name_series, series_keys, side_counts


def unpaired(items: DataFrame) -> DataFrame:
    """Filesystems that have items of one role only, so no report can show them."""
    used = F.col("role") == "used"
    sides = (
        size_items(items)
        .groupBy("hostid", "partition_name")
        .agg(F.count_if(used).alias("used_items"), F.count_if(~used).alias("free_items"))
    )
    missing = F.when(F.col("used_items") == 0, "used").when(F.col("free_items") == 0, "free")
    return sides.withColumn("missing", missing).filter("missing is not null")


def stale_items(stages: Stages) -> DataFrame:
    """Filesystems without a current value, and the side that is to blame."""
    sides = pairs_with_sides(stages.scoped_pairs, stages.scoped_samples, stages.small)
    used, free = F.col("value_used"), F.col("value_free")
    reason = (
        F.when(used.isNull() & free.isNull(), "no used and no free sample")
        .when(used.isNull(), "no used sample")
        .when(free.isNull(), "no free sample")
        .when(used + free == 0, "total is zero")
    )
    return sides.select(
        "hostid", "vm_name", "partition_name", "clock_used", "clock_free", reason.alias("reason")
    ).filter("reason is not null")


def null_p95(stages: Stages) -> DataFrame:
    """Days and NULL days per filesystem next to its percentile.

    NULL days count as days and sort first, so from 95 % NULL days on the
    percentile itself is NULL.
    """
    days = stages.days_by_series
    ranked = rank_within(days, series_keys(days), "usage_pct")
    shares = ranked.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("usage_pct").isNull()).alias("null_days"),
        value_at_rank("usage_pct", stages.q).alias("p95_usage_pct"),
    )
    columns = [
        "days",
        "null_days",
        (F.col("null_days") * 100 / F.col("days")).alias("null_days_pct"),
        "p95_usage_pct",
    ]
    return name_series(shares, stages.scoped_pairs, columns, stages.small)


def unknown_power(stages: Stages) -> DataFrame:
    """Hosts a report shows with an unknown power state, and why."""
    has_item = stages.scoped_power_items.select("hostid").distinct()
    hosts = (
        stages.list_server.join(
            sized(has_item.withColumn("has_item", F.lit(True)), stages.small), "hostid", "left"
        )
        .join(
            sized(stages.scoped_power.withColumn("sampled", F.lit(True)), stages.small),
            "hostid",
            "left",
        )
    )
    known = F.coalesce(F.col("power_state").isin(*POWER_NAMES), F.lit(False))
    reason = (
        F.when(F.col("has_item").isNull(), "no power item")
        .when(F.col("sampled").isNull(), "no recent sample")
        .when(~known, "unrecognised code")
    )
    return hosts.select("hostid", "vm_name", "power_state", reason.alias("reason")).filter(
        "reason is not null"
    )


def key_format(items: DataFrame) -> DataFrame:
    """Disk-size items whose key is not in the expected format."""
    expected = F.coalesce(F.col("key_").rlike(SIZE_KEY_REGEX), F.lit(False))
    odd = items.filter(has_any_role(SIZE_ROLES) & ~expected)
    return odd.select("itemid", "hostid", "name", "key_")


def clock_skew(stages: Stages) -> DataFrame:
    """Buckets per filesystem that have both sides, and those lost for lack of one."""
    used, free = F.col("n_first") > 0, F.col("n_second") > 0
    counts = (
        side_counts(stages.series_rows, stages.window.tz, stages.most_days)
        .groupBy("series_id")
        .agg(
            F.count_if(used & free).alias("aligned"),
            F.count_if(used & ~free).alias("used_only"),
            F.count_if(free & ~used).alias("free_only"),
        )
    )
    return name_series(
        counts, stages.scoped_pairs, ["aligned", "used_only", "free_only"], stages.small
    )


def stage_counts(stages: Stages) -> DataFrame:
    """Rows per stage. The history stages are counted in one pass over the buckets."""
    per_series = (
        stages.buckets.groupBy("series_id", "day")
        .agg(F.count(F.lit(1)).alias("buckets"))
        .groupBy("series_id")
        .agg(F.sum("buckets").alias("buckets"), F.count(F.lit(1)).alias("days"))
    )
    totals = per_series.agg(
        F.coalesce(F.sum("buckets"), F.lit(0)).alias("detail"),
        F.coalesce(F.sum("days"), F.lit(0)).alias("daily"),
        F.count(F.lit(1)).alias("monthly"),
    ).unpivot([], ["detail", "daily", "monthly"], "stage", "rows")
    others = [
        getattr(stages, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name in ("list_server", "item_pair", "need_itemids", "last_clock", "power_state")
    ]
    return reduce(DataFrame.unionByName, others, totals)


def window_coverage(trends: DataFrame, windows: dict[str, TimeWindow]) -> DataFrame:
    """Bounds of each named window and the bucket averages inside it, in one pass."""

    def inside(w):
        return (F.col("clock") >= w.start) & (F.col("clock") < w.end)

    counts = trends.agg(
        *[F.count_if(inside(w)).alias(f"rows_{i}") for i, w in enumerate(windows.values())]
    )
    per_window = [
        F.struct(
            F.lit(name).alias("time_range"),
            F.lit(w.start).cast("long").alias("start_ts"),
            F.lit(w.end).cast("long").alias("end_ts"),
            F.lit(int(w.rolling)).alias("is_rolling_30"),
            F.col(f"rows_{i}").alias("trend_rows"),
        )
        for i, (name, w) in enumerate(windows.items())
    ]
    return counts.select(F.inline(F.array(*per_window)))


def band_counts(stages: Stages) -> DataFrame:
    """Every band with its bounds and the number of filesystems in it."""
    average = F.col("avg_usage_pct")
    counts = stages.summary.agg(
        *[F.count_if(in_band(average, band)).alias(f"rows_{i}") for i, band in enumerate(BANDS)]
    )
    per_band = [
        F.struct(
            F.lit(band.label).alias("threshold"),
            F.lit(band.lower).alias("lower_bound"),
            F.lit(band.upper).alias("upper_bound"),
            F.col(f"rows_{i}").alias("series"),
        )
        for i, band in enumerate(BANDS)
    ]
    return counts.select(F.inline(F.array(*per_band)))
