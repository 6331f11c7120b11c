"""The stages as SQL relations, and the report as a table function with named parameters.

``register_views`` makes a temporary view of every stage under the name the report's users know
it by, so that a stage can be looked at, filtered or joined in plain SQL, and a table function
``disk_report(threshold)``. Nothing is computed before a statement asks for it.
"""

from __future__ import annotations

from operator import attrgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.measures import POWER_NAMES, POWER_UNKNOWN
from fleetgauge.operators.lookup import sized
from fleetgauge.params import BANDS
from fleetgauge.plans.scope import groups_in_scope
from fleetgauge.plans.stages import Stages

# The names of the relations, and the stage each is.
VIEWS = {
    "list_server": "list_server",
    "item_pair": "item_pair",
    "detail": "detail",
    "daily": "daily",
    "monthly": "monthly",
    "need_itemids": "need_itemids",
    "last_clock": "last_clock",
    "las_val": "las_val",
    "current_disk": "current_disk",
    "ordered_daily": "ordered_daily",
    "p95": "p95",
    "power_state": "power_state",
}
OTHERS = ("time_param", "threshold_param", "grup", "items_used", "items_free")
FUNCTION = "disk_report"

_LOWER, _UPPER = attrgetter("lower"), attrgetter("upper")
_POWER = " ".join(f"WHEN {code} THEN '{name}'" for code, name in POWER_NAMES.items())


def report_sql(threshold: str, prefix: str = "") -> str:
    """The report over the views; ``threshold`` is an SQL expression, such as the marker ``:threshold``."""
    views = {name: prefix + name for name in VIEWS} | {name: prefix + name for name in OTHERS}
    series = "USING (hostid, vm_name, partition_name)"
    # Text that is no band has no bounds, so no row is in it.
    lower, upper = (" ".join(f"WHEN '{b.label}' THEN {side(b)}" for b in BANDS) for side in (_LOWER, _UPPER))
    return f"""
SELECT vm_name AS vm, partition_name,
       CASE power_state {_POWER} ELSE '{POWER_UNKNOWN}' END AS PowerState,
       current_usage_pct AS current_disk_pct, avg_usage_pct AS average_disk_pct,
       p95_usage_pct AS percentile_95th_pct
FROM {views["monthly"]}
LEFT JOIN {views["current_disk"]} {series}
LEFT JOIN {views["p95"]} {series}
LEFT JOIN {views["power_state"]} USING (hostid)
WHERE avg_usage_pct > CASE {threshold} {lower} END AND avg_usage_pct <= CASE {threshold} {upper} END"""


ORDER = "ORDER BY average_disk_pct DESC, vm, partition_name"


def _parameters(spark: SparkSession, stages: Stages) -> dict[str, DataFrame]:
    window = stages.window
    one = spark.range(1)
    bands = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(b.label).alias("threshold"),
                    F.lit(b.lower).alias("lower_bound"),
                    F.lit(b.upper).alias("upper_bound"),
                )
                for b in BANDS
            ]
        )
    )
    return {
        "time_param": one.select(
            F.lit(window.start).cast("long").alias("start_ts"),
            F.lit(window.end).cast("long").alias("end_ts"),
            F.lit(int(window.rolling)).alias("is_rolling_30"),
        ),
        "threshold_param": one.select(bands),
    }


def _items(stages: Stages, role: str) -> DataFrame:
    return stages.item_classify.filter(F.col("role") == role).select(
        "hostid", "partition_name", F.col("itemid").alias(f"{role}_itemid")
    )


def register_views(stages: Stages, prefix: str = "") -> None:
    """Temporary views of all stages and the function ``disk_report``, each name with ``prefix``.

    They are those of one scope and window: other prefixes hold other ones side by side.
    ``drop_views`` removes them. The stages' kept results live as long as the stages.
    """
    tables = stages.tables
    spark = tables.items.sparkSession
    found = {view: getattr(stages, stage) for view, stage in VIEWS.items()}
    # A fleet's power states beyond the scope meet no row of the report.
    found["power_state"] = stages.scoped_power
    found |= _parameters(spark, stages)
    found["grup"] = groups_in_scope(tables.hstgrp, stages.policy)
    found |= {f"items_{role}": _items(stages, role) for role in ("used", "free")}
    for name, df in found.items():
        lookup = name in ("current_disk", "p95", "power_state")
        (sized(df, stages.small) if lookup else df).createOrReplaceTempView(prefix + name)
    columns = "vm STRING, partition_name STRING, PowerState STRING, current_disk_pct DOUBLE, average_disk_pct DOUBLE, percentile_95th_pct DOUBLE"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{FUNCTION}(band STRING) RETURNS TABLE ({columns})"
        f" RETURN {report_sql(f'{prefix}{FUNCTION}.band', prefix)}"
    )


def drop_views(spark: SparkSession, prefix: str = "") -> None:
    """Remove what ``register_views`` made with this prefix."""
    for name in (*VIEWS, *OTHERS):
        spark.catalog.dropTempView(prefix + name)
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {prefix}{FUNCTION}")


def sql_report(spark: SparkSession, threshold: str, prefix: str = "") -> DataFrame:
    """The report as one statement with a named marker; text that is no band gives no rows."""
    return spark.sql(f"{report_sql(':threshold', prefix)}\n{ORDER}", args={"threshold": threshold})
