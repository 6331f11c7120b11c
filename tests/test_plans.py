import re

import pytest
from pyspark.sql import functions as F

from fleetgauge import (
    TBN,
    UNPRIORITIZED,
    Stages,
    all_band_rows,
    all_bands_report,
    read_telemetry,
    resolve_window,
    write_telemetry,
)
from fleetgauge.__main__ import main
from fleetgauge.catalogue import AS_OF as LENS_AS_OF
from fleetgauge.catalogue import ROLLING as LENS
from fleetgauge.catalogue import queries
from fleetgauge.operators.lookup import thinned
from fleetgauge.plans import usage
from fleetgauge.sources.lens import lens
from fleetgauge.sources.tables import SCHEMAS, Telemetry
from tests.golden import AS_OF, ROLLING, golden_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("telemetry"))
    write_telemetry(golden_tables(spark), root)
    return read_telemetry(spark, root)


def own_nodes(text):
    """The lines of a plan without those that made a kept result."""
    lines, inside = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line else None
        lines.append(line)
    return "\n".join(lines)


def plan_of(df):
    """The plan's own nodes."""
    return own_nodes(df._jdf.queryExecution().executedPlan().toString())


def final_plan(df):
    """The own nodes of the plan that ran, each query stage where it stands."""
    df.collect()
    return own_nodes(df._jdf.queryExecution().executedPlan().executedPlan().toString())


def scans(plan, table):
    return len(re.findall(rf"FileScan parquet .*/{table}\]", plan))


def test_stored_tables_give_the_same_report(golden, stored):
    expected = all_bands_report(golden, TBN, **ROLLING).collect()
    assert len(expected) == 2
    assert all_bands_report(stored, TBN, **ROLLING).collect() == expected


def test_catalogue_tables(spark, golden):
    for name in SCHEMAS:
        getattr(golden, name).createOrReplaceTempView(name)
    tables = Telemetry.from_tables(spark)
    assert all_bands_report(tables, TBN, **ROLLING).count() == 2
    for name in SCHEMAS:
        spark.catalog.dropTempView(name)


def test_report_reads_the_buckets_once_and_only_the_window(stored):
    stages = Stages(stored, TBN, resolve_window(**ROLLING), AS_OF)
    assert scans(plan_of(all_band_rows(stages)), "trends_uint") == 0
    stages.release()
    stored.items.sparkSession.catalog.clearCache()
    plan = plan_of(usage.counted_days(stages.series_rows, "UTC"))
    assert scans(plan, "trends_uint") == 1
    trends = next(line for line in plan.splitlines() if "trends_uint]" in line)
    assert "dt" in re.search(r"PartitionFilters: \[(.*?)\], ", trends).group(1)
    assert "GreaterThanOrEqual(clock,1704067200), LessThan(clock,1706659200)" in trends
    assert "ReadSchema: struct<itemid:bigint,clock:bigint,value_avg:bigint>" in trends


def test_report_reads_the_samples_once(stored):
    report = all_bands_report(stored, TBN, **ROLLING)
    whole = report._jdf.queryExecution().executedPlan().toString()
    # Current values and power states come from one kept result, which alone reads the samples.
    assert scans(plan_of(report), "history_uint") == 0
    kept = [line for line in whole.splitlines() if "history_uint]" in line]
    assert len(set(re.sub(r"#\d+L?", "", line).strip(" :+-|*()0123456789") for line in kept)) == 1


def test_one_exchange_serves_buckets_and_days(stored):
    stored.items.sparkSession.catalog.clearCache()
    stages = Stages(stored, TBN, resolve_window(**ROLLING), AS_OF)
    counted = usage.counted_days(stages.series_rows, "UTC")
    for days in (counted, stages.buckets.groupBy("series_id", "day").count()):
        plan = plan_of(days)
        assert plan.count("Exchange hashpartitioning") == 1
        assert scans(plan, "trends_uint") == 1
    # Two numbers a side, no lists: the sides are lined up by plain hash aggregates.
    assert "ObjectHashAggregate" not in plan_of(counted) and "collect_list" not in plan_of(counted)
    assert plan_of(stages.summary).count("Exchange hashpartitioning") == 1


def test_days_are_computed_once(stored):
    """All that is made from days reads them where they are kept, and not the bucket averages."""
    stages = Stages(stored, TBN, resolve_window(**ROLLING), AS_OF)
    for df in (stages.days, stages.summary, stages.daily, stages.monthly, stages.p95):
        assert "trends_uint" not in plan_of(df)


def repeating(tables):
    """On every other day bucket averages come once more with another value, some twice."""
    from dataclasses import replace

    more = tables.trends_uint.filter("clock div 86400 % 2 = 0").withColumn("value_avg", F.col("value_avg") + 1000)
    return replace(tables, trends_uint=tables.trends_uint.unionByName(more).unionByName(more.filter("itemid % 2 = 0")))


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repeated"))
    write_telemetry(repeating(lens(spark, SF)), root)
    return read_telemetry(spark, root)


def rounded_rows(df):
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()), key=str
    )


def test_repeated_buckets_combine_from_the_same_exchange(spark, repeated):
    stages = Stages(repeated, TBN, resolve_window(**LENS), LENS_AS_OF)
    rows = stages.series_rows.withColumn("day", F.date_from_unix_date(F.floor(F.col("clock") / 86400).cast("int")))
    used = rows.filter("is_used").select("series_id", "day", "clock", F.col("value_avg").alias("u"))
    free = rows.filter("NOT is_used").select("series_id", "day", "clock", F.col("value_avg").alias("f"))
    both = used.join(free, ["series_id", "day", "clock"])
    plain = both.select("series_id", "day", "clock", (F.col("u") / 2**30).alias("used_gib"), (F.col("f") / 2**30).alias("free_gib"), (100 * F.col("u") / F.nullif(F.col("u") + F.col("f"), F.lit(0))).alias("usage_pct"))
    assert rounded_rows(stages.buckets) == rounded_rows(plain)
    assert plain.groupBy("series_id", "clock").count().filter("count > 1").count() > 0
    means = plain.groupBy("series_id", "day").agg(*[F.avg(c).alias(c) for c in ("used_gib", "free_gib", "usage_pct")])
    days = Stages(repeated, TBN, resolve_window(**LENS), LENS_AS_OF).days
    assert rounded_rows(days) == rounded_rows(means)
    # Rows of other days don't move again.
    assert re.search(r"Exchange hashpartitioning\(series_id#\d+L, date_from(.|\n)*?HashJoin.*LeftSemi", plan_of(days))


def test_days_in_another_zone_need_no_further_exchange(stored):
    stages = Stages(stored, TBN, resolve_window(**ROLLING, tz="Asia/Jakarta"), AS_OF)
    assert plan_of(usage.counted_days(stages.series_rows, "Asia/Jakarta")).count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def by_host(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("by_host"))
    write_telemetry(lens(spark, SF), root, buckets=3)
    return read_telemetry(spark, root)


@pytest.mark.parametrize("tz", ["UTC", "Asia/Jakarta"])
def test_facts_stored_by_host_need_no_exchange_before_the_days(by_host, tz):
    stages = Stages(by_host, TBN, resolve_window(**LENS, tz=tz), LENS_AS_OF)
    plan = final_plan(stages.buckets.groupBy("hostid", "series_id", "day").agg(F.avg("usage_pct")))
    assert "Exchange hashpartitioning" not in plan
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    trends = next(line for line in plan.splitlines() if "trends_uint" in line)
    assert "dt" in re.search(r"PartitionFilters: \[(.*?)\], ", trends).group(1)
    assert "Exchange hashpartitioning" not in plan_of(usage.counted_days(stages.series_rows, tz))
    # Neither do the days of a series have to meet for the summary.
    assert "Exchange hashpartitioning" not in plan_of(usage.summary(usage.counted_days(stages.series_rows, tz), stages.window))


def test_layouts_give_the_same_report(spark, by_host, repeated, tmp_path):
    choice = {**LENS, "tz": "Asia/Jakarta"}
    expected = all_bands_report(lens(spark, SF), TBN, **choice).collect()
    assert expected and all_bands_report(by_host, TBN, **choice).collect() == expected
    assert all_bands_report(by_host, TBN, **choice, broadcast_bytes=0).collect() == expected
    write_telemetry(repeating(lens(spark, SF)), f"{tmp_path}/again", buckets=2)
    again = read_telemetry(spark, f"{tmp_path}/again")
    assert rounded_rows(all_bands_report(again, TBN, **choice)) == rounded_rows(all_bands_report(repeated, TBN, **choice))


def test_written_again_from_a_layout(spark, by_host, tmp_path):
    write_telemetry(by_host, f"{tmp_path}/plain")
    plain = read_telemetry(spark, f"{tmp_path}/plain")
    assert "hostid" not in plain.trends_uint.columns
    for name in SCHEMAS:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        one, two = (getattr(t, name).select(columns) for t in (plain, by_host))
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_unwanted_rows_do_not_reach_an_exchange_beyond_the_broadcast_limit(spark, by_host):
    """The samples that are grouped are those of wanted items, but for a few that pass the filter."""
    stages = Stages(by_host, TBN, resolve_window(**LENS), LENS_AS_OF, broadcast_bytes=0)
    small = Stages(by_host, TBN, resolve_window(**LENS), LENS_AS_OF)
    wanted = stages.need_itemids.unionByName(stages.power_items.select("itemid")).distinct()
    some = wanted.filter("itemid % 7 = 0")
    for facts in (by_host.history_uint, by_host.trends_uint):
        passed = thinned(facts, some, "itemid")
        lost = facts.join(some, "itemid", "left_semi").exceptAll(passed)
        assert lost.isEmpty()
        assert passed.join(some, "itemid", "left_anti").count() <= 0.02 * facts.count()
    plan = plan_of(stages.scoped_samples)
    assert "ubquery" in plan_of(stages.series_rows)
    for name in ("scoped_samples", "power_state", "current_disk", "detail", "las_val"):
        assert rounded_rows(getattr(stages, name)) == rounded_rows(getattr(small, name))
    assert "BroadcastHashJoin" not in plan


def test_no_broadcast_without_a_measured_size(stored):
    plan = plan_of(Stages(stored, TBN, resolve_window(**ROLLING), AS_OF, broadcast_bytes=0).buckets)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_excluded_hosts_are_an_anti_join(stored):
    stages = Stages(stored, UNPRIORITIZED, resolve_window(**ROLLING), AS_OF)
    assert "LeftAnti" in plan_of(stages.list_server)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_query_multiplies_rows_or_leaves_the_jvm(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert operator not in plan


def test_command_line_writes_the_report(spark, golden, tmp_path):
    write_telemetry(golden, f"{tmp_path}/tables")
    choice = ["--tables", f"{tmp_path}/tables", "--as-of", str(AS_OF), "--threshold", ">70.00 AND <=80.00"]
    main([*choice, "--out", f"{tmp_path}/report", "--broadcast-bytes", "1000"])
    assert [r.vm for r in spark.read.parquet(f"{tmp_path}/report").collect()] == ["vm-a"]
