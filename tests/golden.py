"""A six-host fleet written by hand, with every edge case of the report."""

import pyarrow as pa

from fleetgauge.sources.tables import SCHEMAS, Telemetry

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
GIB = 2**30
ROLLING = dict(time_range="30 days ago", as_of=AS_OF)
JANUARY = dict(time_range="2024-01", year=2024, month=1, as_of=AS_OF)


def day(n):
    return 1704067200 + 86400 * (n - 1)


def size_item(itemid, hostid, path, side):
    return (
        itemid,
        hostid,
        f"VMware: {side.capitalize()} disk space on [{path}]",
        "vmware.vm.vfs.fs.size[{$VMWARE.URL},{$VMWARE.VM.UUID},%s,%s]" % (path, side),
    )


def power_item(itemid, hostid):
    return (itemid, hostid, "Power state", "vmware.vm.powerstate[{$VMWARE.URL},{$VMWARE.VM.UUID}]")


def golden_rows():
    renamed = size_item(152, 15, "/", "free")
    trends = []

    def both(used, free, clock, used_gib, free_gib):
        trends.append((used, clock, used_gib * GIB))
        trends.append((free, clock, free_gib * GIB))

    both(101, 102, day(1), 60, 40)
    both(101, 102, day(1) + 3600, 80, 20)
    both(101, 102, day(2), 90, 10)
    both(101, 102, day(1) - 3600, 99, 1)
    both(101, 102, AS_OF, 30, 70)
    trends.append((101, day(3), 99 * GIB))
    trends.append((103, day(1), 1 * GIB))
    both(111, 112, day(1), 0, 100)
    both(121, 122, day(1), 75, 25)
    for n in range(1, 20):
        both(141, 142, day(n), 0, 0)
    both(141, 142, day(20), 50, 50)

    return {
        "hstgrp": [
            (1, "TBN App"),
            (2, "TBN SAP"),
            (3, "01_Critical"),
            (4, "TBN 01-Critical"),
            (5, "Other"),
        ],
        "hosts": [
            (10, "vm-a"),
            (11, "vm-b"),
            (12, "tbn-com-hp1"),
            (13, "vm-c"),
            (14, "vm-d"),
            (15, "vm-e"),
        ],
        "hosts_groups": [
            (10, 1),
            (10, 5),
            (11, 1),
            (11, 3),
            (12, 1),
            (13, 2),
            (14, 4),
            (15, 1),
        ],
        "items": [
            size_item(101, 10, "/", "used"),
            size_item(102, 10, "/", "free"),
            size_item(103, 10, "/", "used"),
            power_item(105, 10),
            size_item(111, 11, "/data", "used"),
            size_item(112, 11, "/data", "free"),
            size_item(121, 12, "/", "used"),
            size_item(122, 12, "/", "free"),
            size_item(141, 14, "C:", "used"),
            size_item(142, 14, "C:", "free"),
            size_item(151, 15, "/", "used"),
            (152, 15, "renamed", renamed[3]),
        ],
        "trends_uint": trends,
        "history_uint": [
            (101, AS_OF - 7200, 70 * GIB),
            (101, AS_OF - 25200, 10 * GIB),
            (102, AS_OF - 7200, 30 * GIB),
            (102, AS_OF - 7200, 20 * GIB),
            (141, AS_OF - 600, 5 * GIB),
            (105, AS_OF - 1800, 1),
            (105, AS_OF - 900, 0),
            (105, AS_OF, 1),
        ],
    }


ARROW_TYPES = {"long": pa.int64(), "string": pa.string()}


def local_frame(spark, rows, schema):
    """A DataFrame of literal rows, without Python workers behind it."""
    columns = [field.split() for field in schema.split(", ")]
    arrow = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in columns])
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(arrow.names, row)) for row in rows], schema=arrow)
    )


def build(spark, rows):
    return Telemetry(
        **{name: local_frame(spark, rows[name], schema) for name, schema in SCHEMAS.items()}
    )


def golden_tables(spark, **extra):
    """The fixture; ``extra`` appends rows to the named tables."""
    rows = golden_rows()
    for name, more in extra.items():
        rows[name] = rows[name] + more
    return build(spark, rows)
