"""A fleet with every documented case, computed from its hosts alone.

Any table of host ids makes one: the customers of the business tables, or ``spark.range`` for a
fleet of any size. All rows come from arithmetic on the id, in the tasks that hold it, so a fleet
is the same however it is distributed. Only the ids are moved, and dealt out first: a host has
hundreds of rows, and a file of a million ids may be one task's.

Items 1 and 3 of a host are used space of ``/`` and ``/data``, 2 and 4 free space, 5 is the power
state, 6 a second power item. By the id: some keys hold a literal percent sign under a name no
pattern matches; averages lie on the bands' edges; some have NULL percentiles, samples with equal
clocks and unlike values, stale sides, a total of zero, no power item, or no recent power state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.text import FREE_KEY, POWER_KEY, USED_KEY
from fleetgauge.params import CURRENT_LOOKBACK, ROLLING_DAYS
from fleetgauge.sources.tables import Telemetry

DAY = 86400
#: Hosts whose rows one task makes.
HOSTS_AT_ONCE = 8192
#: Bytes that one percent of a filesystem is.
PERCENT = 100_000_000

# The groups of the three scopes and of the tiers.
GROUPS = (
    "TBN App", "TBN DB", "TBN SAP", "01_Critical", "TBN 01-Critical", "02_Very High", "03_High",
    "04_Medium", "05_Low", "TBN Web", "Other",
)


def _items(hosts: DataFrame) -> DataFrame:
    each = hosts.selectExpr(
        "hostid",
        "explode(concat(array(1, 2, 3, 4), IF(hostid % 10 = 9, array(), array(5)),"
        " IF(hostid % 5 = 1, array(6), array()))) AS k",
    ).selectExpr(
        "hostid",
        "k",
        "hostid % 7 = 3 AND k IN (3, 4) AS literal",
        "IF(k IN (1, 3), 'used', 'free') AS side",
        "IF(k IN (1, 2), '/', '/data') AS path",
    )
    size_name = F.expr("concat('VMware: ', initcap(side), ' disk space on [', path, ']')")
    size_key = F.expr("concat('vmware.vm.vfs.fs.size[{$VMWARE.URL},{$VMWARE.VM.UUID},', path, ',', side, ']')")
    literal_key = F.when(F.col("side") == "used", USED_KEY).otherwise(FREE_KEY)
    return each.select(
        F.expr("hostid * 10 + k AS itemid"),
        "hostid",
        F.when(F.expr("k >= 5"), "Power state").when(F.col("literal"), "All filesystems").otherwise(size_name).alias("name"),
        F.when(F.expr("k >= 5"), POWER_KEY).when(F.col("literal"), literal_key).otherwise(size_key).alias("key_"),
    )


def _sides(hosts: DataFrame) -> DataFrame:
    """``hostid, k, percent``: the four sides of a host's filesystems and what each holds."""
    percent = "IF(k IN (1, 2), hostid % 21 * 5, hostid % 101)"
    return hosts.selectExpr("hostid", "explode(array(1, 2, 3, 4)) AS k").selectExpr(
        "hostid", "k", f"IF(k IN (1, 3), {percent}, 100 - {percent}) AS percent"
    )


def _trends(hosts: DataFrame, as_of: int, days: int, step: int) -> DataFrame:
    rows = _sides(hosts).withColumn(
        "clock", F.explode(F.sequence(F.lit(as_of - days * DAY), F.lit(as_of + DAY - step), F.lit(step)))
    )
    # Empty filesystems, but for the last day before the present.
    return rows.selectExpr(
        "hostid * 10 + k AS itemid",
        "bigint(clock) AS clock",
        f"IF(hostid % 13 = 5 AND clock < {as_of - DAY}, 0, percent * {PERCENT}) AS value_avg",
    )


def _history(hosts: DataFrame, as_of: int) -> DataFrame:
    moments = F.explode(F.sequence(F.lit(as_of - CURRENT_LOOKBACK - 1200), F.lit(as_of + 600), F.lit(600))).alias("clock")
    sizes = _sides(hosts).filter("NOT (hostid % 8 = 6 AND k IN (1, 3)) AND NOT (hostid % 8 = 7 AND k <= 2) AND NOT (hostid % 16 = 5 AND k = 4)")
    # Some clocks come twice; the later row of the two has the smaller value.
    sizes = sizes.select("hostid", "k", "percent", moments).selectExpr(
        "hostid",
        "k",
        "clock",
        f"explode(IF(hostid % 6 = 2 AND k IN (1, 2), array(percent * {PERCENT} + 5 * {PERCENT}, percent * {PERCENT}),"
        f" array(IF(hostid % 17 = 4, 0, percent * {PERCENT})))) AS value",
    )
    power = hosts.filter("hostid % 9 <> 8").selectExpr("hostid", "explode(array(5, 6)) AS k").select("hostid", "k", moments)
    power = power.selectExpr("hostid", "k", "clock", "IF(k = 5, hostid, hostid + 1) % 4 AS value")
    rows = sizes.unionByName(power)
    return rows.selectExpr("hostid * 10 + k AS itemid", "bigint(clock) AS clock", "bigint(value) AS value")


def fleet(hosts: DataFrame, as_of: int, *, days: int = ROLLING_DAYS + 2, step: int = DAY // 4) -> Telemetry:
    """The telemetry of the hosts whose ids ``hosts`` has in ``hostid``.

    Bucket averages every ``step`` seconds from ``days`` days before ``as_of`` to one day after
    it, samples every ten minutes around the look-back.
    """
    spark = hosts.sparkSession
    ids = hosts.select(F.col("hostid").cast("long").alias("hostid"))
    tasks = -(-ids.count() // HOSTS_AT_ONCE)
    if tasks > 1:
        ids = ids.repartition(tasks)
    groups = spark.range(len(GROUPS)).select(
        F.col("id").alias("groupid"), F.get(F.array(*[F.lit(g) for g in GROUPS]), F.col("id").cast("int")).alias("name")
    )
    return Telemetry(
        hstgrp=groups,
        hosts=ids.selectExpr(
            "hostid",
            "concat(CASE hostid % 20 WHEN 7 THEN 'tbn-com-hp' WHEN 9 THEN 'VC02 - tbn-com-lnv'"
            " WHEN 13 THEN 'tbn-com-mdm' WHEN 16 THEN 'VC02 - tbn-mgt-lnv' ELSE 'vm-' END, hostid) AS name",
        ),
        hosts_groups=ids.selectExpr("hostid", "explode(array_distinct(array(hostid % 11, hostid * 7 % 11))) AS groupid"),
        items=_items(ids),
        trends_uint=_trends(ids, as_of, days, step),
        history_uint=_history(ids, as_of),
    )


def customer_fleet(spark: SparkSession, sf_dir: str, as_of: int) -> Telemetry:
    """A fleet with a host for every customer."""
    return fleet(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS hostid"), as_of)
