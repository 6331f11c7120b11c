"""Report inputs: time window, usage band and host scope.

Everything here is resolved on the driver to plain values, so the plans only
ever see literals and the scan filters can be pushed down.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

# The choice that selects the rolling window, its length and its
# period label, and the two look-backs on recent samples (seconds).
ROLLING_CHOICE = "30 days ago"
ROLLING_DAYS = 30
ROLLING_LABEL = "Last 30 Days"
CURRENT_LOOKBACK = 6 * 3600
POWER_LOOKBACK = 3600

# Fixed value: the percentile the report shows.
P95 = 0.95


@dataclass(frozen=True)
class TimeWindow:
    """Half-open range of epoch seconds, ``[start, end)``, and its time zone."""

    start: int
    end: int
    rolling: bool
    tz: str = "UTC"


def resolve_window(
    time_range: str,
    *,
    as_of: int,
    year: int | None = None,
    month: int | None = None,
    tz: str = "UTC",
) -> TimeWindow:
    """Rolling 30 days for exactly ``"30 days ago"``, else the given month.

    Days and months are calendar units in ``tz``: 30 days over a daylight
    saving switch are not 30 * 86400 seconds.
    """
    zone = ZoneInfo(tz)
    if time_range == ROLLING_CHOICE:
        now = datetime.fromtimestamp(as_of, zone)
        start = int((now - timedelta(days=ROLLING_DAYS)).timestamp())
        return TimeWindow(start, as_of, True, tz)
    if year is None or month is None:
        raise ValueError("a monthly window needs year and month")
    if not 1 <= month <= 12:
        raise ValueError(f"month must be 1..12, got {month}")
    first = datetime(year, month, 1, tzinfo=zone)
    following = datetime(year + month // 12, month % 12 + 1, 1, tzinfo=zone)
    return TimeWindow(int(first.timestamp()), int(following.timestamp()), False, tz)


@dataclass(frozen=True)
class Band:
    """Usage band in percent: above ``lower``, up to and including ``upper``."""

    label: str
    lower: int
    upper: int


# Band labels as the dashboard offers them, with their bounds.
BANDS = (
    Band("<=60.00", 0, 60),
    Band(">60.00 AND <=70.00", 60, 70),
    Band(">70.00 AND <=80.00", 70, 80),
    Band(">80.00 AND <=90.00", 80, 90),
    Band(">90.00", 90, 100),
)


def resolve_band(label: str) -> Band | None:
    """The band with this label; ``None`` (an empty report) for any other text."""
    return next((band for band in BANDS if band.label == label), None)


@dataclass(frozen=True)
class ScopePolicy:
    """Which hosts a report covers.

    A host is in scope when one of its groups matches ``group_like`` and none
    of the group exclusions, its own name matches none of ``host_not_like``,
    and no group it belongs to matches ``host_not_in_groups``.
    """

    name: str
    group_like: str
    group_not_like: str | None = None
    group_not_regex: str | None = None
    host_not_like: tuple[str, ...] = ()
    host_not_in_groups: str | None = None


# Name patterns of the three report scopes.
EXCLUDED_HOSTS = (
    "tbn-com-hp%",
    "tbn-com-mdm%",
    "VC02 - tbn-com-lnv%",
    "VC02 - tbn-mgt-lnv%",
)
TIER_REGEX = "SAP|01_Critical|02_Very High|03_High|04_Medium|05_Low"

TBN = ScopePolicy(
    "tbn",
    group_like="%TBN%",
    group_not_like="%SAP%",
    host_not_like=EXCLUDED_HOSTS,
)
CRITICAL = ScopePolicy(
    "critical",
    group_like="%01_Critical%",
    group_not_like="%SAP%",
    host_not_like=EXCLUDED_HOSTS,
)
UNPRIORITIZED = ScopePolicy(
    "unprioritized",
    group_like="%TBN%",
    group_not_regex=TIER_REGEX,
    host_not_like=EXCLUDED_HOSTS,
    host_not_in_groups=TIER_REGEX,
)
SCOPES = {policy.name: policy for policy in (TBN, CRITICAL, UNPRIORITIZED)}
