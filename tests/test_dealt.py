"""Work that grows with the fleet is dealt to more tasks, with the same rows."""

from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from fleetgauge.catalogue import AS_OF, ROLLING
from fleetgauge.params import TBN, resolve_window
from fleetgauge.plans import checks, usage
from fleetgauge.plans.report import all_band_rows
from fleetgauge.plans.stages import Stages
from fleetgauge.sources import fleet as made

TABLES = ("hosts", "hosts_groups", "items", "trends_uint", "history_uint")


def test_hosts_of_one_file_are_many_tasks_work(spark, monkeypatch):
    hosts = spark.createDataFrame([(i // 2 if i else None,) for i in range(60)], "hostid long").coalesce(1)
    whole = made.fleet(hosts, AS_OF, days=3)
    monkeypatch.setattr(made, "HOSTS_AT_ONCE", 10)
    dealt = made.fleet(hosts, AS_OF, days=3)
    for name in TABLES:
        one, many = getattr(whole, name), getattr(dealt, name)
        assert many.rdd.getNumPartitions() >= 6 > one.rdd.getNumPartitions()
        assertDataFrameEqual(one, many)


def test_days_of_many_series_are_many_tasks_work(spark, monkeypatch):
    hosts = spark.range(120).select(F.col("id").alias("hostid"))
    tables = made.fleet(hosts, AS_OF)

    def found():
        with Stages(tables, TBN, resolve_window(**ROLLING), AS_OF) as stages:
            assert stages.days.count() <= stages.most_days
            frames = (all_band_rows(stages), checks.null_p95(stages), checks.clock_skew(stages), stages.ordered_daily)
            return [f.collect() for f in frames], usage.by_series_and_day(
                stages.series_rows, "UTC", stages.most_days
            ).rdd.getNumPartitions(), stages.most_days

    before, _, most = found()
    monkeypatch.setattr(usage, "DAYS_LINED_UP", 200)
    monkeypatch.setattr(usage, "DAYS_RANKED", 400)
    after, parts, _ = found()
    assert parts == -(-most // 200) > 4
    for one, two in zip(before, after, strict=True):
        assert len(one) > 20 and sorted(map(str, one)) == sorted(map(str, two))
