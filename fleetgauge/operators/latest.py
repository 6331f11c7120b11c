"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(order: str, value: str, when: Column | None = None) -> Column:
    """Aggregate: the struct ``(order, value)`` with the largest ``order``.

    Rows that tie on ``order`` give their largest value. ``when`` limits the
    aggregate to some rows. It combines on the map side, so a key that holds
    most of the input still sends one row per task to the shuffle.
    """
    pair = F.struct(F.col(order), F.col(value))
    return F.max(pair if when is None else F.when(when, pair))


def latest_per_key(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    *,
    since=None,
    until=None,
) -> DataFrame:
    """One row per key: its latest ``order`` in ``[since, until)`` and the value there."""
    rows = df.filter(F.col(order).isNotNull())
    if since is not None:
        rows = rows.filter(F.col(order) >= since)
    if until is not None:
        rows = rows.filter(F.col(order) < until)
    found = rows.groupBy(*keys).agg(latest(order, value).alias("_latest"))
    return found.select(*keys, f"_latest.{order}", f"_latest.{value}")
