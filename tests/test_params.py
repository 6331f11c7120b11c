from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from fleetgauge import BANDS, resolve_band, resolve_window
from tests.golden import AS_OF


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


def test_rolling():
    window = resolve_window("30 days ago", as_of=AS_OF)
    assert (window.start, window.end, window.rolling) == (utc(2024, 1, 1), AS_OF, True)


@pytest.mark.parametrize("text", ["2024-01", "30 Days Ago", "", "last month"])
def test_any_other_choice_is_monthly(text):
    window = resolve_window(text, as_of=AS_OF, year=2024, month=1)
    assert (window.start, window.end, window.rolling) == (utc(2024, 1, 1), utc(2024, 2, 1), False)


def test_december_ends_in_the_next_year():
    window = resolve_window("monthly", as_of=AS_OF, year=2023, month=12)
    assert (window.start, window.end) == (utc(2023, 12, 1), utc(2024, 1, 1))


@pytest.mark.parametrize("month", [0, 13, 112])
def test_month_is_checked(month):
    with pytest.raises(ValueError):
        resolve_window("monthly", as_of=AS_OF, year=2024, month=month)


def test_monthly_needs_year_and_month():
    with pytest.raises(ValueError):
        resolve_window("monthly", as_of=AS_OF)


def test_days_are_calendar_days_across_a_clock_change():
    as_of = int(datetime(2024, 3, 20, 12, tzinfo=ZoneInfo("America/New_York")).timestamp())
    window = resolve_window("30 days ago", as_of=as_of, tz="America/New_York")
    assert window.end - window.start == 30 * 86400 - 3600


def test_month_bounds_follow_the_zone():
    window = resolve_window("monthly", as_of=AS_OF, year=2024, month=1, tz="Asia/Jakarta")
    assert window.start == utc(2023, 12, 31, 17)


def test_bands():
    assert [(b.lower, b.upper) for b in BANDS] == [(0, 60), (60, 70), (70, 80), (80, 90), (90, 100)]
    assert resolve_band(">90.00").lower == 90
    assert resolve_band("> 90") is None
