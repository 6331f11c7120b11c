"""Every operator as a named query over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.operators.latest import latest_per_key
from fleetgauge.operators.means import mean_of_daily_means
from fleetgauge.operators.nearest_rank import nearest_rank
from fleetgauge.operators.pairing import paired_ratio
from fleetgauge.operators.ranges import in_ranges
from fleetgauge.params import P95, ROLLING_CHOICE, SCOPES, TBN, resolve_window
from fleetgauge.plans import checks
from fleetgauge.plans.report import all_bands_report, disk_report
from fleetgauge.plans.stages import Stages
from fleetgauge.sources.fleet import customer_fleet
from fleetgauge.sources.lens import epoch, lens
from fleetgauge.sql import register_views, sql_report

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = 1705708800  # 2024-01-20 00:00:00 UTC: the rolling window and January cut the data at both ends
ROLLING = {"time_range": ROLLING_CHOICE, "as_of": AS_OF}
MONTHLY = {"time_range": "2024-01", "year": 2024, "month": 1, "as_of": AS_OF}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles, so that results can be compared whatever the order of summation."""
    return df.select(
        *[
            F.round(name, DIGITS).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def _stages(spark: SparkSession, sf_dir: str, choice: dict = ROLLING, policy=TBN) -> Stages:
    return Stages(lens(spark, sf_dir), policy, resolve_window(**choice), AS_OF)


def _stage(name: str, choice: dict = ROLLING, policy=TBN) -> Query:
    return lambda spark, sf_dir: rounded(getattr(_stages(spark, sf_dir, choice, policy), name))


def _fleet(spark: SparkSession, sf_dir: str) -> Stages:
    return Stages(customer_fleet(spark, sf_dir, AS_OF), TBN, resolve_window(**ROLLING), AS_OF)


def _fleet_stage(name: str) -> Query:
    return lambda spark, sf_dir: rounded(getattr(_fleet(spark, sf_dir), name))


def _fleet_check(check: Callable[[Stages], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(check(_fleet(spark, sf_dir)))


def fleet_report_all_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_bands_report(customer_fleet(spark, sf_dir, AS_OF), TBN, **ROLLING))


def _check(check: Callable[[Stages], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(check(_stages(spark, sf_dir)))


def _item_check(check: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: check(lens(spark, sf_dir).items)


def _report(scope: str, threshold: str, choice: dict = ROLLING) -> Query:
    return lambda spark, sf_dir: rounded(
        disk_report(lens(spark, sf_dir), SCOPES[scope], threshold=threshold, **choice)
    )


def _all_bands(scope: str, choice: dict = ROLLING) -> Query:
    return lambda spark, sf_dir: rounded(
        all_bands_report(lens(spark, sf_dir), SCOPES[scope], **choice)
    )


def report_all_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_bands("tbn")(spark, sf_dir)


def param_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = {c["time_range"]: resolve_window(**c) for c in (ROLLING, MONTHLY)}
    return checks.window_coverage(lens(spark, sf_dir).trends_uint, choices)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def gen_latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("clock", epoch(F.col("ts")))
    return rounded(latest_per_key(events, ["user_id"], "clock", "value"))


def gen_nearest_rank_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = nearest_rank(lineitem, ["l_suppkey"], "l_extendedprice", P95)
    return rounded(found.withColumnRenamed("percentile", "p95_price"))


def gen_mean_of_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rounded(mean_of_daily_means(events, ["user_id"], "day", ["value"]))


def gen_paired_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    click, view = F.col("event_type") == "click", F.col("event_type") == "view"
    found = paired_ratio(events, ["user_id", "day"], click, view, F.col("value"))
    return rounded(found.withColumnsRenamed({"first": "clicks", "second": "views"}))


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band of percentages per nation; they overlap and are of many lengths, some empty or open."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.selectExpr(
        "n_name AS level",
        "double(n_nationkey * 4 - 2) AS lower",
        "IF(n_nationkey = 7, double('Infinity'), double(n_nationkey * 4 - 2 + (n_nationkey * n_nationkey) % 23)) AS upper",
    )


def series_in_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filesystem with all alert levels, a table of overlapping bands, that hold its average."""
    stages = _stages(spark, sf_dir)
    names = stages.monthly.select("hostid", "vm_name", "partition_name", "avg_usage_pct")
    return rounded(in_ranges(names, "avg_usage_pct", _overlapping(spark, sf_dir)))


def gen_events_in_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their sum for each of the overlapping bands."""
    events = _events(spark, sf_dir).select("event_id", "value")
    found = in_ranges(events, "value", _overlapping(spark, sf_dir))
    return rounded(found.groupBy("level").agg(F.count("*").alias("events"), F.sum("value").alias("total")))


def _sql(query: Callable[[SparkSession, str], DataFrame], policy=TBN) -> Query:
    """A statement over the views of a scope; the views' prefix is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prefix = f"fleetgauge_{policy.name}_"
        register_views(_stages(spark, sf_dir, policy=policy), prefix)
        return rounded(query(spark, prefix))

    return run


def _sql_report(spark: SparkSession, prefix: str) -> DataFrame:
    return sql_report(spark, ">70.00 AND <=80.00", prefix)


def _sql_function(spark: SparkSession, prefix: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {prefix}disk_report('>90.00') ORDER BY average_disk_pct DESC, vm, partition_name")


def _sql_look_monthly(spark: SparkSession, prefix: str) -> DataFrame:
    return spark.sql(
        f"SELECT hostid, vm_name, partition_name, avg_usage_pct FROM {prefix}monthly"
        " ORDER BY avg_usage_pct DESC NULLS LAST, hostid, partition_name LIMIT :most",
        args={"most": 10},
    )


def _sql_look_pairs(spark: SparkSession, prefix: str) -> DataFrame:
    return spark.sql(
        f"SELECT hostid, partition_name, used_itemid, free_itemid FROM {prefix}item_pair"
        f" WHERE hostid = (SELECT max(hostid) FROM {prefix}monthly)"
    )


def queries() -> dict[str, Query]:
    found = {
        "param_time_window": param_time_window,
        "param_bands": _check(checks.band_counts),
        **{f"scope_{name}": _stage("list_server", policy=p) for name, p in SCOPES.items()},
        "item_classify": _stage("item_classify"),
        "item_pair": _stage("item_pair"),
        "needed_items": _stage("need_itemids"),
        "usage_detail": _stage("detail"),
        "usage_daily": _stage("daily"),
        "usage_period_rolling": _stage("monthly"),
        "usage_period_monthly": _stage("monthly", MONTHLY),
        "daily_ranked": _stage("ordered_daily"),
        "p95_discrete": _stage("p95"),
        "latest_clock": _stage("last_clock"),
        "latest_value": _stage("las_val"),
        "current_usage": _stage("current_disk"),
        "power_state": _stage("power_state"),
        "report_tbn": _report("tbn", ">70.00 AND <=80.00"),
        "report_critical": _report("critical", "<=60.00"),
        "report_unprioritized": _report("unprioritized", ">80.00 AND <=90.00"),
        "report_tbn_monthly": _report("tbn", ">90.00", MONTHLY),
        "report_all_bands": report_all_bands,
        **{f"report_all_bands_{scope}": _all_bands(scope) for scope in ("critical", "unprioritized")},
        **{f"report_all_bands_{scope}_monthly": _all_bands(scope, MONTHLY) for scope in SCOPES},
        "usage_daily_jakarta": _stage("daily", {**ROLLING, "tz": "Asia/Jakarta"}),
        "fleet_item_pair": _fleet_stage("item_pair"),
        "fleet_usage_period": _fleet_stage("monthly"),
        "fleet_latest_value": _fleet_stage("las_val"),
        "fleet_power_state": _fleet_stage("power_state"),
        "fleet_report_all_bands": fleet_report_all_bands,
        "fleet_stale_items": _fleet_check(checks.stale_items),
        "fleet_null_p95": _fleet_check(checks.null_p95),
        "fleet_unknown_power": _fleet_check(checks.unknown_power),
        "sql_report_tbn": _sql(_sql_report),
        "sql_report_function": _sql(_sql_function),
        "sql_look_monthly": _sql(_sql_look_monthly),
        "sql_look_item_pair": _sql(_sql_look_pairs),
        "series_in_levels": series_in_levels,
        "gen_events_in_levels": gen_events_in_levels,
        "diag_unpaired": _item_check(checks.unpaired),
        "diag_key_format": _item_check(checks.key_format),
        "diag_stale_items": _check(checks.stale_items),
        "diag_null_p95": _check(checks.null_p95),
        "diag_unknown_power": _check(checks.unknown_power),
        "diag_clock_skew": _check(checks.clock_skew),
        "diag_stage_counts": _check(checks.stage_counts),
        "gen_latest_event_per_user": gen_latest_event_per_user,
        "gen_nearest_rank_price": gen_nearest_rank_price,
        "gen_mean_of_daily_means": gen_mean_of_daily_means,
        "gen_paired_ratio": gen_paired_ratio,
    }
    return found
