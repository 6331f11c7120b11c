"""All stages of one report, each a DataFrame that can be inspected.

The first stage that needs the hosts in scope measures the hosts and computes the pairs and
power items in scope, and the first that needs days computes the daily means; both are kept for
the later stages, and all else is lazy. What is kept is let go by ``release``, at the end of a ``with`` block, or after nothing holds the stages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators.lookup import measured_together, within_limit
from fleetgauge.operators.settle import Kept
from fleetgauge.params import P95, ScopePolicy, TimeWindow
from fleetgauge.plans import current, items, scope, usage
from fleetgauge.sources.tables import Telemetry


_DAY = 86400
# A member has at least this data size: four numbers and two texts.
_MEMBER_BYTES = 48


class Stages:
    """The stages for one scope, window and as-of time (epoch seconds)."""

    def __init__(
        self,
        tables: Telemetry,
        policy: ScopePolicy,
        window: TimeWindow,
        as_of: int,
        *,
        q: float = P95,
        broadcast_bytes: int | None = None,
    ):
        self.tables = tables
        self.policy = policy
        self.window = window
        self.as_of = as_of
        self.q = q
        self.broadcast_bytes = broadcast_bytes
        self._kept = Kept()

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error) -> None:
        self.release()

    def release(self) -> None:
        """Let the kept results go. Stages asked for afterwards are made anew."""
        self._kept.release()
        for name in [n for n in vars(self) if isinstance(getattr(type(self), n, None), cached_property)]:
            delattr(self, name)

    @cached_property
    def list_server(self) -> DataFrame:
        """Hosts in scope."""
        return scope.hosts_in_scope(self.tables, self.policy, within_limit(self._sizes[0], self.broadcast_bytes))

    @cached_property
    def item_classify(self) -> DataFrame:
        """Disk-size items of the whole fleet with their role."""
        return items.size_items(self.tables.items)

    @cached_property
    def item_pair(self) -> DataFrame:
        """Pairs of the whole fleet."""
        return items.pair_items(self.item_classify)

    @cached_property
    def need_itemids(self) -> DataFrame:
        """Items of all pairs."""
        return items.needed_items(self.item_pair)

    @cached_property
    def power_items(self) -> DataFrame:
        """Power items of the whole fleet."""
        return items.power_items(self.tables.items)

    @cached_property
    def _sizes(self) -> tuple[int, int]:
        """Data sizes of the groups and the hosts, measured by one job."""
        return measured_together([self.tables.hstgrp, self.tables.hosts])

    @cached_property
    def _settled(self) -> tuple[DataFrame, int]:
        # The scope is a part of the hosts, so it is as small as those.
        small = within_limit(self._sizes[1], self.broadcast_bytes)
        return self._kept.settle(items.members(self.tables.items, self.list_server, small))

    @property
    def members(self) -> DataFrame:
        """Pairs and power items in scope, computed once: every later stage starts here."""
        return self._settled[0]

    @property
    def small(self) -> bool:
        """Whether ``members``, and so anything with a row per member, fits a broadcast."""
        return within_limit(self._settled[1], self.broadcast_bytes)

    @cached_property
    def most_days(self) -> int:
        """A bound on the days of all series of the window, from the data size of ``members``."""
        return self._settled[1] // _MEMBER_BYTES * (-(-(self.window.end - self.window.start) // _DAY) + 1)

    @cached_property
    def scoped_pairs(self) -> DataFrame:
        """Pairs of the hosts in scope, with names."""
        return self.members.filter(F.col("used_itemid").isNotNull()).drop("power_itemid")

    @cached_property
    def scoped_power_items(self) -> DataFrame:
        """Power items of the hosts in scope."""
        power = self.members.filter(F.col("power_itemid").isNotNull())
        return power.select(F.col("power_itemid").alias("itemid"), "hostid")

    @cached_property
    def series_rows(self) -> DataFrame:
        """Bucket averages of the window, in scope, by series and side."""
        trends = self.tables.trends_uint
        return usage.series_rows(trends, self.scoped_pairs, self.window, self.small)

    @cached_property
    def buckets(self) -> DataFrame:
        """Aligned buckets in scope by series."""
        return usage.usage_buckets(self.series_rows, self.window.tz, self.most_days)

    @cached_property
    def _counted_days(self) -> tuple[DataFrame, int]:
        """Daily means before repeated buckets are combined, and the number of days with any."""
        days = self._kept.keep(usage.counted_days(self.series_rows, self.window.tz, self.most_days))
        return days, days.filter("repeats > 0").count()

    @cached_property
    def days(self) -> DataFrame:
        """Daily means in scope by series, computed once."""
        counted, repeated = self._counted_days
        return usage.usage_days(counted, self.series_rows, self.window.tz, repeated)

    @cached_property
    def days_by_series(self) -> DataFrame:
        """``days``, dealt out by series if they are many, to be ranked."""
        return usage.by_series(self.days, self.most_days)

    @cached_property
    def summary(self) -> DataFrame:
        """Period mean and percentile in scope by series."""
        return usage.summary(self.days_by_series, self.window, self.q)

    @cached_property
    def detail(self) -> DataFrame:
        """Aligned buckets in scope."""
        return usage.usage_detail(self.buckets, self.scoped_pairs, self.small)

    @cached_property
    def daily(self) -> DataFrame:
        """Daily means in scope."""
        return usage.usage_daily(self.days, self.scoped_pairs, self.small)

    @cached_property
    def monthly(self) -> DataFrame:
        """Period means in scope."""
        return usage.usage_period(self.summary, self.scoped_pairs, self.small)

    @cached_property
    def ordered_daily(self) -> DataFrame:
        """Ranked days in scope."""
        return usage.daily_ranked(self.days_by_series, self.scoped_pairs, self.small)

    @cached_property
    def p95(self) -> DataFrame:
        """Percentiles in scope."""
        return usage.p95(self.summary, self.scoped_pairs, self.small)

    @cached_property
    def _fleet_items(self) -> tuple[DataFrame, int]:
        """Paired and power items of the fleet: ``itemid, hostid`` with a NULL host if paired."""
        paired = self.need_itemids.select("itemid", F.lit(None).cast("long").alias("hostid"))
        return self._kept.settle(paired.unionByName(self.power_items))

    @cached_property
    def _fleet_recent(self) -> DataFrame:
        wanted, size = self._fleet_items
        small = within_limit(size, self.broadcast_bytes)
        items = wanted.select("itemid").distinct()
        recent = current.recent_samples(self.tables.history_uint, items, self.as_of, small)
        return self._kept.keep(recent)

    @cached_property
    def _scoped_recent(self) -> DataFrame:
        """One read of the samples, kept, for the current values and the power states in scope."""
        items = usage.series_items(self.scoped_pairs).select("itemid")
        wanted = items.union(self.scoped_power_items.select("itemid")).distinct()
        recent = current.recent_samples(self.tables.history_uint, wanted, self.as_of, self.small)
        return self._kept.keep(recent)

    @cached_property
    def fleet_samples(self) -> DataFrame:
        """Latest sample of every paired item of the fleet."""
        paired = self._fleet_items[0].filter("hostid IS NULL").select("itemid")
        return current.current_samples(self._fleet_recent).join(paired, "itemid", "left_semi")

    @cached_property
    def scoped_samples(self) -> DataFrame:
        """Latest sample of the items in scope."""
        return current.current_samples(self._scoped_recent)

    @cached_property
    def last_clock(self) -> DataFrame:
        """Latest clock of every paired item of the fleet."""
        return current.latest_clock(self.fleet_samples)

    @cached_property
    def las_val(self) -> DataFrame:
        """Latest value of every paired item of the fleet."""
        return self.fleet_samples

    @cached_property
    def current_disk(self) -> DataFrame:
        """Current usage in scope."""
        return current.current_usage(self.scoped_pairs, self.scoped_samples, self.small)

    @cached_property
    def scoped_power(self) -> DataFrame:
        """Power state of the hosts in scope."""
        samples = current.power_samples(self._scoped_recent)
        return current.power_state(self.scoped_power_items, samples, self.small)

    @cached_property
    def power_state(self) -> DataFrame:
        """Power state of the whole fleet."""
        items, size = self._fleet_items
        power = items.filter("hostid IS NOT NULL")
        samples = current.power_samples(self._fleet_recent)
        return current.power_state(power, samples, within_limit(size, self.broadcast_bytes))

    def inspect(self, stage: str, limit: int = 10, **equal) -> DataFrame:
        """A few rows of a stage, for a look at it: ``inspect("item_pair", hostid=10)``."""
        rows = getattr(self, stage)
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == value)
        return rows.limit(limit)
