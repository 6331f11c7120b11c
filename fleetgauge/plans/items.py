"""Which series describe a filesystem, and which the power state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.text import (
    FREE_KEY,
    FREE_NAME,
    POWER_KEY,
    USED_KEY,
    USED_NAME,
    filesystem,
)
from fleetgauge.operators.lookup import lookup_join

SIZE_ROLES = ("used", "free")
ALL_ROLES = ("used", "free", "power")


def _has_role(role: str) -> Column:
    name, key = F.col("name"), F.col("key_")
    if role == "power":
        return key == POWER_KEY
    if role == "used":
        return name.like(USED_NAME) | (key == USED_KEY)
    return name.like(FREE_NAME) | (key == FREE_KEY)


def has_any_role(roles: tuple[str, ...]) -> Column:
    """True for an item with at least one of ``roles``."""
    return reduce(lambda one, other: one | other, [_has_role(role) for role in roles])


def classify(items: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """``itemid, hostid, role, partition_name`` of the items that have a role.

    One read of the catalogue for all roles; an item with two roles is listed
    twice. Power items have no filesystem.
    """
    found = []
    for role in roles:
        path = F.lit(None).cast("string") if role == "power" else filesystem(F.col("key_"), role)
        found.append(
            F.struct(
                _has_role(role).alias("has"), F.lit(role).alias("role"), path.alias("partition_name")
            )
        )
    return (
        items.filter(has_any_role(roles))
        .select("itemid", "hostid", F.inline(F.array(*found)))
        .filter("has")
        .select("itemid", "hostid", "role", "partition_name")
    )


def size_items(items: DataFrame) -> DataFrame:
    """``itemid, hostid, role, partition_name`` of the used- and free-space items."""
    return classify(items, SIZE_ROLES)


def power_items(items: DataFrame) -> DataFrame:
    """``itemid, hostid`` of the power-state items."""
    return items.filter(_has_role("power")).select("itemid", "hostid")


def _pairs(known: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest used and free item per key.

    The smallest item of each role stands for its duplicates. The minimum over
    a join of the two roles is the minimum of each, so no join is needed and
    duplicates never multiply.
    """
    return known.groupBy(*keys).agg(
        F.min(F.when(F.col("role") == "used", F.col("itemid"))).alias("used_itemid"),
        F.min(F.when(F.col("role") == "free", F.col("itemid"))).alias("free_itemid"),
    )


def pair_items(sizes: DataFrame) -> DataFrame:
    """``hostid, partition_name, used_itemid, free_itemid`` per filesystem with both roles."""
    known = sizes.filter(F.col("hostid").isNotNull() & F.col("partition_name").isNotNull())
    return _pairs(known, ["hostid", "partition_name"]).filter(_both_sides())


def members(items: DataFrame, scope: DataFrame, small: bool) -> DataFrame:
    """The pairs and the power items of the hosts in ``scope``, as one table.

    ``small`` says that ``scope`` was measured to fit a broadcast.
    A row has ``used_itemid`` and ``free_itemid``, or ``power_itemid``. One read
    of the catalogue, cut to the scope before anything is grouped.
    """
    power = F.col("role") == "power"
    known = (
        classify(items, ALL_ROLES)
        .filter(power | F.col("partition_name").isNotNull())
        .withColumn("power_itemid", F.when(power, F.col("itemid")))
    )
    known = lookup_join(known, scope, "hostid", small=small)
    keys = ["hostid", "vm_name", "partition_name", "power_itemid"]
    return _pairs(known, keys).filter(F.col("power_itemid").isNotNull() | _both_sides())


def _both_sides() -> Column:
    return F.col("used_itemid").isNotNull() & F.col("free_itemid").isNotNull()


def needed_items(pairs: DataFrame) -> DataFrame:
    """Distinct ``itemid`` of both sides of all pairs."""
    both = F.explode(F.array("used_itemid", "free_itemid")).alias("itemid")
    return pairs.select(both).distinct()
