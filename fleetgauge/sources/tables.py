"""The six telemetry tables: schemas, reading and a layout for large fleets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions.clocks import DATE_PARTITION, local_day
from fleetgauge.operators.lookup import fits_broadcast, lookup_join

SCHEMAS = {
    "hstgrp": "groupid long, name string",
    "hosts": "hostid long, name string",
    "hosts_groups": "hostid long, groupid long",
    "items": "itemid long, hostid long, name string, key_ string",
    "trends_uint": "itemid long, clock long, value_avg long",
    "history_uint": "itemid long, clock long, value long",
}
FACTS = ("trends_uint", "history_uint")
# Column by which facts may be stored, and the table that tells in how many buckets.
HOST = "hostid"
LAYOUT = "layout"


def typed(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns in their types, and what a stored fact table has besides.

    That is the date column, and the host where the table is stored by host.

    Exports bring the source's unsigned numbers as decimals. A missing column is an error
    here, a value that does not fit its type when it is read.
    """
    wanted = T.StructType.fromDDL(SCHEMAS[table])
    missing = [field.name for field in wanted if field.name not in df.columns]
    if missing:
        raise ValueError(f"{table} has no column {', '.join(missing)}")
    columns = [
        F.col(f.name) if df.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in wanted
    ]
    layout = [DATE_PARTITION, *([HOST] if table in FACTS else [])]
    known = {f.name for f in wanted}
    return df.select(*columns, *[c for c in layout if c in df.columns and c not in known])


@dataclass(frozen=True)
class Telemetry:
    """Group, host, membership and item tables, bucket averages and raw samples.

    A fact table with a ``dt`` column must hold the UTC date of ``clock`` there, one with a
    ``hostid`` column the host of ``itemid``; an item belongs to one host for good.
    Keys: ``groupid``, ``hostid``, ``(hostid, groupid)``, ``itemid``. Bucket averages have
    one row per ``(itemid, clock)`` as a rule, raw samples have no key.
    """

    hstgrp: DataFrame
    hosts: DataFrame
    hosts_groups: DataFrame
    items: DataFrame
    trends_uint: DataFrame
    history_uint: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, database: str | None = None) -> Telemetry:
        """Tables or views of the session's catalogue."""
        prefix = f"{database}." if database else ""
        return cls(**{name: typed(spark.table(prefix + name), name) for name in SCHEMAS})


def read_telemetry(spark: SparkSession, root: str) -> Telemetry:
    """Parquet tables under ``root``, in any layout that ``write_telemetry`` makes or plain.

    Facts stored by host are registered in the session's catalogue, under a name made from
    their place, since only a table of the catalogue can tell Spark its buckets.
    """
    buckets = _buckets(spark, root)

    def read(name: str) -> DataFrame:
        path = f"{root}/{name}"
        return _registered(spark, path, name, buckets) if buckets and name in FACTS else spark.read.parquet(path)

    return Telemetry(**{name: typed(read(name), name) for name in SCHEMAS})


def _buckets(spark: SparkSession, root: str) -> int | None:
    """In how many buckets the facts under ``root`` are stored, if they are."""
    try:
        return spark.read.parquet(f"{root}/{LAYOUT}").first()["buckets"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _registered(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    name = f"fleetgauge_{table}_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    order = ", ".join(_BY_HOST[1:])
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({SCHEMAS[table]}, {HOST} long, {DATE_PARTITION} date) USING parquet"
        f" PARTITIONED BY ({DATE_PARTITION}) CLUSTERED BY ({HOST}) SORTED BY ({order})"
        f" INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


_BY_HOST = [DATE_PARTITION, HOST, "itemid", "clock"]


def write_telemetry(
    tables: Telemetry, root: str, mode: str = "errorifexists", buckets: int | None = None
) -> None:
    """Store the tables as parquet, the two fact tables by UTC date.

    Rows are range-partitioned by date, item and clock: the ranges are cut from
    a sample, so a busy day or item spreads over several files, and each file
    holds a narrow range of items for row-group skipping.

    With ``buckets`` the facts get the host of their item and are stored by date and
    bucket of hosts. Days and periods then need no exchange. A bucket of a window is one
    task's work, so there should be as many as executors' cores, and a host of more than a
    bucket's share is better stored without them. Rows of unknown items have no host.
    """
    for field in fields(tables):
        df = getattr(tables, field.name)
        path = f"{root}/{field.name}"
        if field.name not in FACTS:
            df.write.mode(mode).parquet(path)
            continue
        dated = df.withColumn(DATE_PARTITION, local_day(F.col("clock"), "UTC"))
        if buckets:
            _write_by_host(dated.drop(HOST), tables.items, path, mode, buckets)
            continue
        order = [DATE_PARTITION, "itemid", "clock"]
        dated = dated.drop(HOST).repartitionByRange(*order).sortWithinPartitions(*order)
        dated.write.partitionBy(DATE_PARTITION).mode(mode).parquet(path)
    if buckets:
        spark = tables.items.sparkSession
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode(mode).parquet(f"{root}/{LAYOUT}")


def _write_by_host(dated: DataFrame, items: DataFrame, path: str, mode: str, buckets: int) -> None:
    hosts = items.select("itemid", HOST)
    found = lookup_join(dated, hosts, "itemid", small=fits_broadcast(hosts), how="left")
    # One file for a date and bucket: this is how Spark numbers buckets.
    bucket = F.pmod(F.hash(HOST), F.lit(buckets))
    dealt = found.withColumn("bucket", bucket).repartition(DATE_PARTITION, "bucket")
    name = f"fleetgauge_write_{uuid4().hex}"
    writer = dealt.sortWithinPartitions(DATE_PARTITION, "bucket", *_BY_HOST[1:]).drop("bucket").write
    writer = writer.partitionBy(DATE_PARTITION).bucketBy(buckets, HOST).sortBy(*_BY_HOST[1:])
    writer.mode(mode).option("path", path).saveAsTable(name)
    # The files stay: a table with a place of its own is dropped without them.
    dated.sparkSession.sql(f"DROP TABLE {name}")
