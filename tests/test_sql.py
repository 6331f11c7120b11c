"""The stages as SQL relations, and joins to tables of intervals."""

import math
import random

import pytest

from fleetgauge import BANDS, TBN, Stages, disk_report, resolve_window
from fleetgauge.operators.ranges import in_ranges
from fleetgauge.sql import OTHERS, VIEWS, drop_views, register_views, report_sql, sql_report
from tests.golden import AS_OF, ROLLING


def test_one_statement_gives_the_report(spark, golden):
    stages = Stages(golden, TBN, resolve_window(**ROLLING), AS_OF)
    register_views(stages)
    assert {v.name for v in spark.catalog.listTables()} >= {*VIEWS, *OTHERS}
    rows = 0
    for threshold in [*(b.label for b in BANDS), "no such band", "90' OR 'x' = 'x"]:
        expected = disk_report(golden, TBN, threshold=threshold, **ROLLING).collect()
        found = sql_report(spark, threshold)
        assert found.collect() == expected
        assert found.columns == ["vm", "partition_name", "PowerState", "current_disk_pct", "average_disk_pct", "percentile_95th_pct"]
        rows += len(expected)
    assert rows >= 2
    one = spark.sql("SELECT * FROM disk_report(:band)", args={"band": ">70.00 AND <=80.00"}).collect()
    assert one == disk_report(golden, TBN, threshold=">70.00 AND <=80.00", **ROLLING).collect() != []
    assert spark.table("time_param").count() == 1 and spark.table("threshold_param").count() == len(BANDS)
    used, free = (spark.table(f"items_{role}").count() for role in ("used", "free"))
    assert used + free == stages.item_classify.count()
    drop_views(spark)
    assert not {v.name for v in spark.catalog.listTables()} & {*VIEWS, *OTHERS}


def test_views_of_two_windows_side_by_side(spark, golden):
    for prefix, choice in (("a_", ROLLING), ("b_", {"time_range": "2023-12", "year": 2023, "month": 12, "as_of": AS_OF})):
        register_views(Stages(golden, TBN, resolve_window(**choice), AS_OF), prefix)
    counts = [spark.table(f"{p}monthly").count() for p in ("a_", "b_")]
    assert counts[0] > 0 and counts[0] != counts[1]
    assert "a_monthly" in report_sql(":threshold", "a_")
    for prefix in ("a_", "b_"):
        drop_views(spark, prefix)


INTERVALS = [
    ("whole", 0.0, 100.0), ("low", -5.0, 10.0), ("tiny", 9.999, 10.0), ("edge", 10.0, 20.0), ("empty", 5.0, 5.0),
    ("turned", 9.0, 1.0), ("open", 50.0, math.inf), ("all", -math.inf, math.inf), ("null", None, 3.0),
    ("nan", math.nan, 1.0), ("wide", -1e12, 1e12), ("twice", 0.0, 100.0), ("twice", 0.0, 100.0),
]


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_intervals_that_hold_a_value(spark, broadcast_bytes):
    rng = random.Random(1)
    values = [0.0, 10.0, 10.000001, 20.0, -5.0, 100.0, 1e300, -1e300, math.inf, -math.inf, math.nan, None, 9.9995]
    values += [rng.uniform(-20, 130) for _ in range(200)] + [10.0] * 5
    intervals = INTERVALS + [(f"r{i}", a := rng.uniform(-20, 120), a + 10 ** rng.uniform(-6, 2)) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    ranges = spark.createDataFrame(intervals, "name string, lower double, upper double")
    found = in_ranges(df, "v", ranges, broadcast_bytes=broadcast_bytes)
    expected = [
        (i, name) for i, v in enumerate(values) for name, low, high in intervals
        if v is not None and low is not None and low < v <= high
    ]
    assert sorted((r.id, r.name) for r in found.collect()) == sorted(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ("BroadcastHashJoin" in plan) == (broadcast_bytes is None)


def test_no_intervals_and_no_values(spark):
    df = spark.createDataFrame([(1, 5.0)], "id int, v double")
    ranges = spark.createDataFrame([("a", 0.0, 9.0)], "name string, lower double, upper double")
    assert in_ranges(df, "v", ranges.limit(0)).collect() == []
    assert in_ranges(df.limit(0), "v", ranges).collect() == []
    assert in_ranges(df, "v", ranges).collect() == [(1, 5.0, "a", 0.0, 9.0)]
    with pytest.raises(ValueError):
        in_ranges(df.withColumnRenamed("id", "lower"), "v", ranges)
