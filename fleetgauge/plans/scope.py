"""Which hosts a report covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.text import matches_none
from fleetgauge.operators.lookup import lookup_join
from fleetgauge.params import ScopePolicy
from fleetgauge.sources.tables import Telemetry


def groups_in_scope(hstgrp: DataFrame, policy: ScopePolicy) -> DataFrame:
    """``groupid`` of the groups a policy selects by name."""
    name = F.col("name")
    keep = name.like(policy.group_like)
    if policy.group_not_like is not None:
        keep = keep & ~name.like(policy.group_not_like)
    if policy.group_not_regex is not None:
        keep = keep & ~name.rlike(policy.group_not_regex)
    return hstgrp.filter(keep).select("groupid")


def hosts_in_scope(tables: Telemetry, policy: ScopePolicy, small: bool) -> DataFrame:
    """``hostid, vm_name`` of the hosts a policy covers, once each.

    Membership is a semi join, so a host in many groups is never multiplied. ``small`` says
    that the groups were measured to fit a broadcast.
    """
    members = _members(tables.hosts_groups, groups_in_scope(tables.hstgrp, policy), small)
    hosts = (
        tables.hosts.filter(matches_none(F.col("name"), policy.host_not_like))
        .select("hostid", F.col("name").alias("vm_name"))
        .join(members, "hostid", "left_semi")
    )
    if policy.host_not_in_groups is not None:
        flagged = tables.hstgrp.filter(F.col("name").rlike(policy.host_not_in_groups))
        barred = _members(tables.hosts_groups, flagged.select("groupid"), small)
        hosts = hosts.join(barred, "hostid", "left_anti")
    return hosts.distinct()


def _members(hosts_groups: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    chosen = lookup_join(hosts_groups, groups, "groupid", small=small, how="left_semi")
    return chosen.select("hostid").distinct()
