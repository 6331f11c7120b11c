"""The six telemetry tables, derived from star-schema business tables.

Suppliers stand for hosts, nations for host groups, and the event stream for
the samples: every four users are one host, and the event type says which of
its items an event is a sample of. All rows of the source tables are used.

Items 1 and 3 of a host are used space of ``/`` and ``/data``, 2 and 4 free
space, 5 is the power state and 6 a second item for the series of item 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.text import POWER_KEY
from fleetgauge.sources.tables import Telemetry

SOURCES = {
    "nation": "n_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "events": "user_id long, event_type string, ts timestamp_ntz, value double",
}


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, ts)


def _samples(events: DataFrame) -> DataFrame:
    rows = events.select(
        F.expr("user_id div 4 AS hostid"),
        epoch(F.col("ts")).alias("clock"),
        F.expr(
            "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3"
            " WHEN 'signup' THEN 4 ELSE 5 END AS k"
        ),
        "value",
    )
    # A third of the hosts is 20 days early, a third 20 days late. The used side is larger than
    # the free side by a factor of the host.
    return rows.selectExpr(
        "hostid",
        "clock + (hostid % 3 - 1) * 1728000 AS clock",
        "k",
        "CASE WHEN k = 5 THEN floor(value) % 4"
        " ELSE floor(value * 100) * 10737418 * IF(k IN (1, 3),"
        "  element_at(array(1, 2, 4, 8, 40), int(hostid % 5) + 1), 1) END AS value",
    )


def _items(samples: DataFrame) -> DataFrame:
    seen = samples.select("hostid", "k").distinct()
    # Some hosts have a second item, some name the two sides of a filesystem
    # differently, some use an older key format.
    rows = seen.selectExpr(
        "hostid", "explode(IF(k = 1 AND hostid % 9 = 2, array(1, 6), array(k))) AS k"
    ).selectExpr(
        "hostid",
        "k",
        "IF(k IN (1, 3, 6), 'used', 'free') AS side",
        "CASE WHEN k IN (1, 2, 6) THEN '/' WHEN k = 4 AND hostid % 13 = 5 THEN '/data-old'"
        " ELSE '/data' END AS path",
    )
    prefix = F.expr(
        "IF(k IN (3, 4) AND hostid % 17 = 3, 'legacy.fs.size[',"
        " 'vmware.vm.vfs.fs.size[{$VMWARE.URL},{$VMWARE.VM.UUID},')"
    )
    size_key = F.concat(prefix, F.expr("concat(path, ',', side, ']')"))
    return rows.select(
        F.expr("hostid * 10 + k AS itemid"),
        "hostid",
        F.expr(
            "IF(k = 5, 'Power state',"
            " concat('VMware: ', initcap(side), ' disk space on [', path, ']')) AS name"
        ),
        F.when(F.col("k") == 5, POWER_KEY).otherwise(size_key).alias("key_"),
    )


def _trends(samples: DataFrame) -> DataFrame:
    # Six-hour buckets; some hosts report empty filesystems every other day.
    return (
        samples.filter("k <> 5")
        .selectExpr(
            "hostid * 10 + k AS itemid",
            "clock - clock % 21600 AS clock",
            "IF(hostid % 11 = 4 AND clock % 172800 < 86400, 0, value) AS value",
        )
        .groupBy("itemid", "clock")
        .agg(F.max("value").alias("value_avg"))
    )


def lens(spark: SparkSession, sf_dir: str) -> Telemetry:
    """Telemetry tables over ``nation``, ``supplier`` and ``events`` in ``sf_dir``."""
    nation, supplier, events = (
        spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
        for name, schema in SOURCES.items()
    )
    samples = _samples(events)
    return Telemetry(
        hstgrp=nation.selectExpr(
            "bigint(n_nationkey) AS groupid",
            "element_at(array('TBN App', 'TBN DB', 'TBN SAP', '01_Critical', 'TBN 01-Critical',"
            " '02_Very High', '03_High', '04_Medium', '05_Low', 'TBN Web', 'Other'),"
            " n_nationkey % 11 + 1) AS name",
        ),
        hosts=supplier.selectExpr(
            "s_suppkey AS hostid",
            "concat(CASE s_suppkey % 20 WHEN 7 THEN 'tbn-com-hp' WHEN 9 THEN 'VC02 - tbn-com-lnv'"
            " WHEN 13 THEN 'tbn-com-mdm' WHEN 16 THEN 'VC02 - tbn-mgt-lnv' ELSE 'vm-' END, s_suppkey)"
            " AS name",
        ),
        hosts_groups=supplier.selectExpr(
            "s_suppkey AS hostid",
            "explode(array_distinct(array(bigint(s_nationkey), (s_nationkey + s_suppkey) % 25)))"
            " AS groupid",
        ),
        items=_items(samples),
        trends_uint=_trends(samples),
        history_uint=samples.selectExpr("hostid * 10 + k AS itemid", "clock", "value"),
    )
