"""Unit conversions and derived measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024 * 1024 * 1024

# Power codes and the names the report shows for them.
POWER_NAMES = {0: "Powered Off", 1: "Powered On", 2: "Suspended"}
POWER_UNKNOWN = "Unknown"


def gib(size: Column) -> Column:
    """Bytes to GiB."""
    return size.cast("double") / GIB


def share_pct(part: Column, rest: Column) -> Column:
    """``part`` as a percentage of ``part + rest``; NULL when the total is 0 or unknown."""
    part, rest = part.cast("double"), rest.cast("double")
    return part / F.nullif(part + rest, F.lit(0.0)) * 100


def power_name(code: Column) -> Column:
    """Display name of a power code; any other code, and NULL, is unknown."""
    names = [F.when(code == value, text) for value, text in POWER_NAMES.items()]
    return F.coalesce(*names, F.lit(POWER_UNKNOWN))
