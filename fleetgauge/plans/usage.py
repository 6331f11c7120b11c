"""Usage over time from the bucket averages: buckets, days, period, percentile.

Between the stages a filesystem is known by ``series_id`` (its used-space
item), so the shuffled rows are a few numbers wide. Names are joined to the
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.clocks import clock_range, day_label, local_day, period_label
from fleetgauge.functions.measures import gib, share_pct
from fleetgauge.operators.lookup import lookup_join, sized, thinned, within_limit
from fleetgauge.operators.means import daily_means
from fleetgauge.operators.nearest_rank import rank_within, value_at_rank
from fleetgauge.operators.pairing import pivot_sides
from fleetgauge.params import P95, TimeWindow

# Column of fact tables that are stored by host.
HOST = "hostid"
# A series and a day.
_DAY_BYTES = 16
# Series' days whose buckets one task lines up, and days that one task ranks.
DAYS_LINED_UP = 1 << 18
DAYS_RANKED = 1 << 20
MEASURES = ["used_gib", "free_gib", "usage_pct"]


def series_items(pairs: DataFrame) -> DataFrame:
    """``itemid, series_id, is_used``: the series and the side of every paired item."""

    def side(itemid, is_used):
        return F.struct(F.col(itemid).alias("itemid"), F.lit(is_used).alias("is_used"))

    both = F.explode(F.array(side("used_itemid", True), side("free_itemid", False))).alias("s")
    return pairs.select(F.col("used_itemid").alias("series_id"), both).select(
        "s.itemid", "series_id", "s.is_used"
    )


def series_rows(
    trends: DataFrame, pairs: DataFrame, window: TimeWindow, small: bool
) -> DataFrame:
    """``series_id, is_used, clock, value_avg`` of the window's bucket averages.

    ``small`` says that ``pairs`` was measured to fit a broadcast. Beyond it most rows of
    items that no pair has are left out before the rows move. Rows that are stored by host
    keep their ``hostid`` and so their place, as long as no join moves them.
    """
    rows = clock_range(trends, window.start, window.end)
    columns = ["itemid", "clock", "value_avg"]
    items = series_items(pairs)
    host = [HOST] if small and HOST in trends.columns else []
    if not small:
        rows = thinned(rows, items.select("itemid"), "itemid")
    tagged = lookup_join(rows.select(*columns, *host), items, "itemid", small=small)
    return tagged.select(*host, "series_id", "is_used", "clock", "value_avg")


def series_keys(df: DataFrame) -> list[str]:
    """What a series is grouped by: its host too where the rows are stored by host."""
    return [HOST, "series_id"] if HOST in df.columns else ["series_id"]


def _dealt(df: DataFrame, parts: int, *columns) -> DataFrame:
    """``df`` in an exchange by ``columns``, in ``parts`` partitions where the session has fewer."""
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(parts, *columns)
    return df.repartition(*columns)


def by_series_and_day(rows: DataFrame, tz: str, most: int = 0) -> DataFrame:
    """The rows in one exchange by series and day, which also serves the daily means.

    The day itself is added after it, so it is not shuffled. Rows stored by host lie
    together already and need no exchange. Partitions grow in number with ``most``, a bound on
    the days of all series, so that none grows with the fleet.
    """
    day = local_day(F.col("clock"), tz)
    if HOST not in rows.columns:
        rows = _dealt(rows, -(-most // DAYS_LINED_UP), "series_id", day)
    return rows.withColumn("day", day)


def by_series(days: DataFrame, most: int) -> DataFrame:
    """Days in one exchange by series where they are too many for the session's partitions."""
    parts = -(-most // DAYS_RANKED)
    if HOST in days.columns or parts <= int(days.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return days
    return days.repartition(parts, "series_id")


def _sides(dealt: DataFrame, value) -> DataFrame:
    """Per series and bucket: a value and the number of rows of the used and the free side."""
    used = F.col("is_used")
    return pivot_sides(dealt, [*series_keys(dealt), "day", "clock"], used, ~used, value, F.max)


def side_counts(rows: DataFrame, tz: str, most: int = 0) -> DataFrame:
    """``n_first``/``n_second``: rows of the used and the free side per series and bucket."""
    return _sides(by_series_and_day(rows, tz, most), F.lit(None))


def _measured(aligned: DataFrame, *others: str) -> DataFrame:
    return aligned.select(
        *series_keys(aligned),
        "day",
        "clock",
        *others,
        gib(F.col("used")).alias("used_gib"),
        gib(F.col("free")).alias("free_gib"),
        share_pct(F.col("used"), F.col("free")).alias("usage_pct"),
    )


def _combined(dealt: DataFrame) -> DataFrame:
    """``used, free`` of every combination of the two sides' rows of a bucket.

    The values of a bucket's free side are gathered next to each of its used rows. A day
    has 86400 clock values, and a bucket has one value a side unless rows repeat.
    """
    keys = [*series_keys(dealt), "day", "clock"]
    side = F.col("is_used")
    value = F.struct(F.col("value_avg").alias("v"))
    gathered = dealt.groupBy(*keys).agg(
        F.collect_list(F.when(side, value)).alias("used"),
        F.collect_list(F.when(~side, value)).alias("free"),
    )
    return (
        gathered.select(*keys, F.explode("used").alias("u"), "free")
        .select(*keys, "u", F.explode("free").alias("f"))
        .select(*keys, F.col("u.v").alias("used"), F.col("f.v").alias("free"))
    )


def usage_buckets(rows: DataFrame, tz: str, most: int = 0) -> DataFrame:
    """``series_id, day, clock, used_gib, free_gib, usage_pct`` per aligned bucket.

    A bucket needs a row of each side at the same clock; should rows repeat,
    every combination of theirs is a row. One read and one exchange.
    """
    return _measured(_combined(by_series_and_day(rows, tz, most)))


def counted_days(rows: DataFrame, tz: str, most: int = 0) -> DataFrame:
    """Daily means per series, and in ``repeats`` how many of the day's buckets have several rows a side.

    The two sides are lined up by their largest values, which are the only ones unless rows
    repeat: half the work of ``usage_buckets``. A day that repeats is right after ``usage_days``.
    """
    dealt = by_series_and_day(rows, tz, most)
    keys = series_keys(dealt)
    repeats = (F.col("n_first") > 1) | (F.col("n_second") > 1)
    aligned = (
        _sides(dealt, F.col("value_avg"))
        .filter("n_first > 0 AND n_second > 0")
        .select(*keys, "day", "clock", F.col("first").alias("used"), F.col("second").alias("free"), repeats.alias("repeated"))
    )
    means = [F.avg(m).alias(m) for m in MEASURES]
    return _measured(aligned, "repeated").groupBy(*keys, "day").agg(*means, F.count_if("repeated").alias("repeats"))


def usage_days(counted: DataFrame, rows: DataFrame, tz: str, repeated: int) -> DataFrame:
    """Daily means per series: the means of ``usage_buckets``.

    ``repeated`` is the number of days in ``counted`` that have a repeated bucket. Only those
    are done anew, from rows that are read again and cut to them before they move.
    """
    once = counted.filter("repeats = 0").drop("repeats")
    if not repeated:
        return counted.drop("repeats")
    keys = series_keys(counted)
    some = counted.filter("repeats > 0").select("series_id", "day")
    dated = rows.withColumn("day", local_day(F.col("clock"), tz))
    small = within_limit(repeated * _DAY_BYTES)
    again = lookup_join(dated, some, ["series_id", "day"], small=small, how="left_semi")
    buckets = _measured(_combined(by_series_and_day(again.drop("day"), tz, repeated)))
    return once.unionByName(daily_means(buckets, keys, "day", MEASURES))


def summary(days: DataFrame, window: TimeWindow, q: float = P95) -> DataFrame:
    """Per series and period: mean of the daily means and nearest-rank percentile.

    One exchange for both: a group is the days of one series, at most the
    length of the window.
    """
    keys = series_keys(days)
    ranked = rank_within(days, keys, "usage_pct")
    return ranked.groupBy(*keys, period_label(F.col("day"), window).alias("bulan")).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in MEASURES],
        value_at_rank("usage_pct", q).alias("p95_usage_pct"),
    )


# The stages with their documented columns.


def _names(pairs: DataFrame) -> DataFrame:
    series = F.col("used_itemid").alias("series_id")
    return pairs.select(series, "hostid", "vm_name", "partition_name")


def name_series(
    df: DataFrame, pairs: DataFrame, columns: list[str | Column], small: bool
) -> DataFrame:
    """Replace ``series_id`` by host, VM and filesystem names; for results, not for facts."""
    named = df.drop(HOST).join(sized(_names(pairs), small), "series_id")
    return named.select("hostid", "vm_name", "partition_name", *columns)


def usage_detail(buckets: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """Every aligned bucket with names."""
    named = lookup_join(buckets.drop(HOST), _names(pairs), "series_id", small=small)
    return named.select(
        "hostid",
        "vm_name",
        "clock",
        day_label(F.col("day")).alias("day"),
        "partition_name",
        *MEASURES,
    )


def usage_daily(days: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """Daily means with names."""
    return name_series(days, pairs, [day_label(F.col("day")).alias("day"), *MEASURES], small)


def usage_period(summarised: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """Mean of the daily means per period, with names."""
    columns = ["bulan", *[f"avg_{m}" for m in MEASURES]]
    return name_series(summarised, pairs, columns, small)


def daily_ranked(days: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """Days in ascending order of usage within their series, equal days by date."""
    ranked = rank_within(days, series_keys(days), "usage_pct", tie_break=["day"])
    return name_series(ranked, pairs, ["usage_pct", "rn", "cnt"], small)


def p95(summarised: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """Nearest-rank percentile of the daily means, with names."""
    return name_series(summarised, pairs, ["p95_usage_pct"], small)
