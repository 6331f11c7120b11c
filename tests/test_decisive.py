"""The derived tables decide the semantics: a changed filter changes the answers."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetgauge import SCOPES, Stages, resolve_window
from fleetgauge.catalogue import AS_OF, MONTHLY, ROLLING
from fleetgauge.params import EXCLUDED_HOSTS, TIER_REGEX
from fleetgauge import BANDS, all_bands_report
from fleetgauge.catalogue import queries
from fleetgauge.functions.text import FREE_KEY, USED_KEY
from fleetgauge.operators import bands
from fleetgauge.plans import current, items, usage
from fleetgauge.sources.fleet import customer_fleet, fleet
from fleetgauge.sources.lens import lens
from tests.compare import connect, duckdb_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return lens(spark, SF)


@pytest.mark.parametrize("choice", [ROLLING, MONTHLY])
def test_the_window_cuts_at_both_ends(tables, choice):
    window = resolve_window(**choice)
    clocks = tables.trends_uint
    assert clocks.filter(f"clock < {window.start}").count() > 0
    assert clocks.filter(f"clock >= {window.end}").count() > 0
    assert clocks.filter(f"clock >= {window.start} AND clock < {window.end}").count() > 0


def test_the_windows_differ(tables):
    counts = [
        Stages(tables, SCOPES["tbn"], resolve_window(**choice), AS_OF).series_rows.count()
        for choice in (ROLLING, MONTHLY)
    ]
    assert counts[0] != counts[1]


def test_samples_lie_on_both_sides_of_the_present(tables):
    assert tables.history_uint.filter(f"clock >= {AS_OF}").count() > 0
    assert tables.history_uint.filter(f"clock BETWEEN {AS_OF} - 3600 AND {AS_OF} - 1").count() > 0
    assert tables.history_uint.filter(f"clock < {AS_OF} - 21600").count() > 0


def hosts(tables, policy):
    return {r.hostid for r in Stages(tables, policy, resolve_window(**ROLLING), AS_OF).list_server.collect()}


@pytest.mark.parametrize("pattern", EXCLUDED_HOSTS)
def test_every_excluded_pattern_bars_hosts(tables, pattern):
    policy = SCOPES["tbn"]
    fewer = replace(policy, host_not_like=tuple(p for p in policy.host_not_like if p != pattern))
    assert hosts(tables, policy) < hosts(tables, fewer)


@pytest.mark.parametrize("tier", TIER_REGEX.split("|"))
def test_every_tier_bars_hosts(tables, tier):
    policy = SCOPES["unprioritized"]
    rest = "|".join(t for t in TIER_REGEX.split("|") if t != tier)
    fewer = replace(policy, host_not_in_groups=rest, group_not_regex=rest)
    assert hosts(tables, policy) < hosts(tables, fewer)


@pytest.fixture(scope="module")
def customers(spark):
    return customer_fleet(spark, SF, AS_OF)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def is_red(spark, con, name):
    from fleetgauge.oracle import oracle_sql

    return spark_rows(queries()[name](spark, SF)) != duckdb_rows(con, oracle_sql()[name])


def without_literal_keys(monkeypatch):
    monkeypatch.setattr(items, "USED_KEY", "no such key")
    monkeypatch.setattr(items, "FREE_KEY", "no such key")


def smallest_of_equal_clocks(monkeypatch):
    def least(order, value, when=None):
        pair = F.struct(F.col(order), (-F.col(value)).alias(value))
        found = F.max(pair if when is None else F.when(when, pair))
        return F.when(found.isNotNull(), F.struct(found[order].alias(order), (-found[value]).alias(value)))

    monkeypatch.setattr(current, "latest", least)


def one_power_item(monkeypatch):
    state = current.power_state
    monkeypatch.setattr(current, "power_state", lambda *a: state(*a).groupBy("hostid").agg(F.max("power_state").alias("power_state")))


def open_upper_edge(monkeypatch):
    from fleetgauge.plans import report

    monkeypatch.setattr(bands, "in_band", lambda value, band: (value > band.lower) & (value < band.upper))
    monkeypatch.setattr(report, "band_label", bands.band_label)


def nulls_skipped(monkeypatch):
    rank = usage.rank_within
    monkeypatch.setattr(usage, "rank_within", lambda df, keys, value, **o: rank(df.filter(F.col(value).isNotNull()), keys, value, **o))


@pytest.mark.parametrize(
    "change, name",
    [
        (without_literal_keys, "fleet_item_pair"),
        (smallest_of_equal_clocks, "fleet_latest_value"),
        (smallest_of_equal_clocks, "fleet_report_all_bands"),
        (one_power_item, "fleet_report_all_bands"),
        (open_upper_edge, "fleet_report_all_bands"),
        (nulls_skipped, "fleet_report_all_bands"),
    ],
)
def test_a_removed_rule_turns_its_row_red(spark, con, monkeypatch, change, name):
    change(monkeypatch)
    assert is_red(spark, con, name)


def test_the_fleet_has_every_case(spark, customers):
    assert customers.items.filter(F.col("key_").isin(USED_KEY, FREE_KEY)).count() > 100
    rows = all_bands_report(customers, SCOPES["tbn"], **ROLLING).collect()
    assert {r.PowerState for r in rows} == {"Powered Off", "Powered On", "Suspended", "Unknown"}
    assert {r.band for r in rows} == {b.label for b in BANDS}
    assert {float(b.upper) for b in BANDS} <= {round(r.average_disk_pct, 9) for r in rows}
    assert any(r.percentile_95th_pct is None for r in rows) and any(r.current_disk_pct is None for r in rows)
    assert len({(r.vm, r.partition_name) for r in rows}) < len(rows)
    reasons = {r.reason for r in queries()["fleet_stale_items"](spark, SF).collect()}
    assert reasons == {"no used and no free sample", "no used sample", "no free sample", "total is zero"}
    reasons = {r.reason for r in queries()["fleet_unknown_power"](spark, SF).collect()}
    assert reasons == {"no power item", "no recent sample", "unrecognised code"}


def test_a_fleet_does_not_depend_on_its_distribution(spark):
    one, two = (fleet(spark.range(1, 60, 1, n).withColumnRenamed("id", "hostid"), AS_OF, days=2) for n in (1, 7))
    for name in ("items", "trends_uint", "history_uint", "hosts_groups"):
        a, b = getattr(one, name), getattr(two, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()
