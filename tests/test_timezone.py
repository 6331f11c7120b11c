import pytest

from fleetgauge import TBN, Stages, resolve_window
from tests.golden import AS_OF, ROLLING, day


def days_of(tables, tz):
    window = resolve_window(**ROLLING, tz=tz)
    rows = Stages(tables, TBN, window, AS_OF).detail.filter("hostid = 10").collect()
    return {r.clock: r.day for r in rows}


@pytest.mark.parametrize(
    "tz,first",
    [
        ("UTC", "2024-01-01"),
        ("Asia/Jakarta", "2024-01-01"),
        ("America/New_York", "2023-12-31"),
    ],
)
def test_day_follows_the_given_zone(golden, tz, first):
    found = days_of(golden, tz)
    assert found[day(1)] == first
    assert found[day(2)] == ("2024-01-01" if tz == "America/New_York" else "2024-01-02")


@pytest.mark.parametrize("session_zone", ["Asia/Jakarta", "America/New_York"])
def test_session_zone_does_not_matter(spark, golden, session_zone):
    expected = days_of(golden, "UTC"), days_of(golden, "Asia/Jakarta")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        assert (days_of(golden, "UTC"), days_of(golden, "Asia/Jakarta")) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_monthly_label_in_a_zone(golden):
    window = resolve_window("monthly", as_of=AS_OF, year=2024, month=1, tz="Asia/Jakarta")
    found = Stages(golden, TBN, window, AS_OF).monthly.collect()
    assert {r.bulan for r in found} == {"2024-01"}
    assert len({(r.hostid, r.partition_name) for r in found}) == len(found)
