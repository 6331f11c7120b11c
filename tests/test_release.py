"""What reports keep with the executors is let go."""

import gc

import pytest

from fleetgauge import BANDS, CRITICAL, TBN, Stages, all_band_rows, all_bands_report, band_rows, disk_report
from fleetgauge import release_dropped, resolve_window
from fleetgauge.catalogue import AS_OF, ROLLING, queries
from tests.golden import AS_OF as GOLDEN_AS_OF
from tests.golden import ROLLING as GOLDEN

SF = "/root/testdata/sf0.001"


def kept_tables(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


@pytest.fixture(autouse=True)
def nothing_kept(spark):
    gc.collect()
    release_dropped()
    spark.catalog.clearCache()


def test_one_set_of_stages_serves_several_reports(spark, golden):
    expected = {band.label: disk_report(golden, TBN, threshold=band.label, **GOLDEN).collect() for band in BANDS}
    release_dropped()
    with Stages(golden, TBN, resolve_window(**GOLDEN), GOLDEN_AS_OF) as stages:
        assert {band.label: band_rows(stages, band.label).collect() for band in BANDS} == expected
        assert kept_tables(spark) == 3
        assert all_band_rows(stages).count() == sum(map(len, expected.values())) > 0
        assert kept_tables(spark) == 3
    assert kept_tables(spark) == 0
    # Stages can be used again.
    assert all_band_rows(stages).count() == 2
    stages.release()
    assert kept_tables(spark) == 0


def test_ten_reports_leave_nothing(spark, golden):
    for policy in (TBN, CRITICAL):
        for band in BANDS:
            disk_report(golden, policy, threshold=band.label, **GOLDEN).collect()
            assert kept_tables(spark) <= 6
    release_dropped()
    assert kept_tables(spark) == 0


def test_a_report_that_is_held_keeps_its_results(spark, golden):
    one = all_bands_report(golden, TBN, **GOLDEN)
    rows = one.collect()
    disk_report(golden, CRITICAL, threshold=">90.00", **GOLDEN).collect()
    release_dropped()
    assert kept_tables(spark) == 3
    later = one.filter("band is not null")
    del one
    release_dropped()
    assert kept_tables(spark) == 0
    # What was derived from it is computed anew.
    assert later.collect() == rows


@pytest.mark.parametrize("name", ["report_tbn", "diag_stage_counts", "power_state"])
def test_queries_leave_nothing(spark, name):
    queries()[name](spark, SF).collect()
    release_dropped()
    assert kept_tables(spark) == 0


def test_released_in_the_middle_gives_the_same_rows(spark):
    from fleetgauge.sources.lens import lens

    stages = Stages(lens(spark, SF), TBN, resolve_window(**ROLLING), AS_OF)
    report = all_band_rows(stages)
    rows = report.collect()
    stages.release()
    assert report.collect() == rows
