"""The report: filesystems by average usage, with current, percentile and power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.measures import power_name, share_pct
from fleetgauge.operators.bands import band_label, in_band
from fleetgauge.operators.lookup import sized
from fleetgauge.params import ScopePolicy, resolve_band, resolve_window
from fleetgauge.plans.current import current_sides
from fleetgauge.plans.stages import Stages
from fleetgauge.plans.usage import HOST
from fleetgauge.sources.tables import Telemetry


def report_rows(stages: Stages, filtered: DataFrame) -> DataFrame:
    """Named and enriched rows of a filtered summary.

    The filter comes first, so only the filesystems reported are enriched. The
    enrichment joins are left joins: missing samples never drop a row. A host
    with two power items gives two rows.
    """
    pairs, small = stages.scoped_pairs, stages.small
    names = pairs.withColumn("series_id", F.col("used_itemid"))
    sides = current_sides(stages.scoped_samples, pairs, small)
    return (
        filtered.drop(HOST)
        .join(sized(names, small), "series_id")
        .join(sized(sides, small), "series_id", "left")
        .join(sized(stages.scoped_power, small), "hostid", "left")
        .select(
            F.col("vm_name").alias("vm"),
            "partition_name",
            power_name(F.col("power_state")).alias("PowerState"),
            share_pct(F.col("value_used"), F.col("value_free")).alias("current_disk_pct"),
            F.col("avg_usage_pct").alias("average_disk_pct"),
            F.col("p95_usage_pct").alias("percentile_95th_pct"),
        )
    )


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("average_disk_pct"), "vm", "partition_name")


def band_rows(stages: Stages, threshold: str) -> DataFrame:
    """The report of one band from stages that may serve several reports."""
    banded = stages.summary.filter(in_band(F.col("avg_usage_pct"), resolve_band(threshold)))
    return _ordered(report_rows(stages, banded))


def all_band_rows(stages: Stages) -> DataFrame:
    """The reports of all bands, with a ``band`` column, from stages that may serve several reports."""
    banded = stages.summary.filter(band_label(F.col("avg_usage_pct")).isNotNull())
    rows = report_rows(stages, banded)
    return _ordered(rows.select(band_label(F.col("average_disk_pct")).alias("band"), "*"))


def _holding(report: DataFrame, stages: Stages) -> DataFrame:
    """``report``; what its stages keep is let go after it is dropped."""
    report._fleetgauge_stages = stages
    return report


def disk_report(
    tables: Telemetry,
    policy: ScopePolicy,
    *,
    threshold: str,
    time_range: str,
    as_of: int,
    year: int | None = None,
    month: int | None = None,
    tz: str = "UTC",
    **options,
) -> DataFrame:
    """Filesystems whose average usage lies in a band, highest first.

    ``threshold`` is a band label; other text gives an empty report.
    ``time_range`` is ``"30 days ago"`` or anything else for ``year``/``month``.
    ``as_of`` is the one present instant of the report, in epoch seconds.
    ``options`` go to ``Stages``. Several reports of one window share their work as
    ``with Stages(...) as stages: band_rows(stages, threshold)``.
    """
    window = resolve_window(time_range, as_of=as_of, year=year, month=month, tz=tz)
    stages = Stages(tables, policy, window, as_of, **options)
    return _holding(band_rows(stages, threshold), stages)


def all_bands_report(
    tables: Telemetry,
    policy: ScopePolicy,
    *,
    time_range: str,
    as_of: int,
    year: int | None = None,
    month: int | None = None,
    tz: str = "UTC",
    **options,
) -> DataFrame:
    """The reports of all bands in one run, with a ``band`` column."""
    window = resolve_window(time_range, as_of=as_of, year=year, month=month, tz=tz)
    stages = Stages(tables, policy, window, as_of, **options)
    return _holding(all_band_rows(stages), stages)
