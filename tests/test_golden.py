import pytest

from fleetgauge import CRITICAL, TBN, UNPRIORITIZED, Stages, disk_report, resolve_window
from tests.golden import AS_OF, GIB, JANUARY, ROLLING, golden_tables, power_item, size_item

VM_A = ("vm-a", "/", "Powered Off", 70.0, 80.0, 90.0)
VM_D = ("vm-d", "C:", "Unknown", None, 50.0, None)


def rows_of(df):
    return [
        tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()
    ]


def stages(tables, policy=TBN, tz="UTC", **options):
    return Stages(tables, policy, resolve_window(**ROLLING, tz=tz), AS_OF, **options)


@pytest.mark.parametrize(
    "policy,choice,threshold,expected",
    [
        (TBN, ROLLING, ">70.00 AND <=80.00", [VM_A]),
        (TBN, ROLLING, "<=60.00", [VM_D]),
        (CRITICAL, ROLLING, "<=60.00", [VM_D]),
        (UNPRIORITIZED, ROLLING, "<=60.00", [VM_D]),
        (TBN, JANUARY, ">60.00 AND <=70.00", [("vm-a", "/", "Powered Off", 70.0, 63.333333, 90.0)]),
        (CRITICAL, ROLLING, ">70.00 AND <=80.00", []),
        (UNPRIORITIZED, ROLLING, ">70.00 AND <=80.00", [VM_A]),
        (TBN, ROLLING, "anything else", []),
    ],
)
def test_report(golden, policy, choice, threshold, expected):
    report = disk_report(golden, policy, threshold=threshold, **choice)
    assert report.columns == [
        "vm",
        "partition_name",
        "PowerState",
        "current_disk_pct",
        "average_disk_pct",
        "percentile_95th_pct",
    ]
    assert rows_of(report) == expected


@pytest.mark.parametrize(
    "policy,hosts",
    [(TBN, {10, 11, 14, 15}), (CRITICAL, {11, 14}), (UNPRIORITIZED, {10, 14, 15})],
)
def test_scope(golden, policy, hosts):
    found = stages(golden, policy).list_server.collect()
    assert sorted(r.hostid for r in found) == sorted(hosts)


def test_pairs(golden):
    found = stages(golden).item_pair.collect()
    assert {tuple(r) for r in found} == {
        (10, "/", 101, 102),
        (11, "/data", 111, 112),
        (12, "/", 121, 122),
        (14, "C:", 141, 142),
    }


def test_literal_percent_key_is_an_equality(spark):
    key = "vmware.vm.vfs.fs.size[{$VMWARE.URL},{$VMWARE.VM.UUID},%,free]"
    tables = golden_tables(spark, items=[(153, 15, "renamed", key)])
    found = {r.itemid: r.partition_name for r in stages(tables).item_classify.collect()}
    assert found[153] == "%"
    assert 152 not in found


def test_item_with_both_names_has_both_roles(spark):
    name = "VMware: Used disk space on VMware: Free disk space on [x]"
    tables = golden_tables(spark, items=[(900, 15, name, "k[},x,used,free]")])
    found = stages(tables).item_classify.filter("itemid = 900").collect()
    assert {(r.role, r.partition_name) for r in found} == {("used", "x"), ("free", "x,used")}


def test_key_parsing_edges(spark):
    tables = golden_tables(
        spark,
        items=[
            (901, 15, "VMware: Used disk space on [a]", "legacy.size[/a,used]"),
            (902, 15, "VMware: Used disk space on [a]", "k[{x},/a,used-up,used]"),
            (903, 15, "VMware: Used disk space on [a]", None),
        ],
    )
    found = {r.itemid: r.partition_name for r in stages(tables).item_classify.collect()}
    assert found[901] == "legacy.size[/a"
    assert found[902] == "/a"
    assert found[903] is None
    assert stages(tables).item_pair.filter("hostid = 15").count() == 0


def test_two_power_items_give_two_rows(spark):
    tables = golden_tables(
        spark, items=[power_item(106, 10)], history_uint=[(106, AS_OF - 60, 2)]
    )
    found = rows_of(disk_report(tables, TBN, threshold=">70.00 AND <=80.00", **ROLLING))
    assert sorted(r[2] for r in found) == ["Powered Off", "Suspended"]


def test_sample_after_as_of_counts_for_current_only(spark):
    tables = golden_tables(
        spark,
        history_uint=[(101, AS_OF + 60, 20 * GIB), (102, AS_OF + 60, 80 * GIB), (105, AS_OF + 60, 2)],
    )
    found = rows_of(disk_report(tables, TBN, threshold=">70.00 AND <=80.00", **ROLLING))
    assert found == [("vm-a", "/", "Powered Off", 20.0, 80.0, 90.0)]


def test_power_ties_take_the_larger_code(spark):
    tables = golden_tables(spark, history_uint=[(105, AS_OF - 900, 1), (105, AS_OF - 900, 0)])
    assert [r.power_state for r in stages(tables).power_state.collect()] == [1]


def test_unknown_power_code(spark):
    tables = golden_tables(spark, history_uint=[(105, AS_OF - 1, 7)])
    found = rows_of(disk_report(tables, TBN, threshold=">70.00 AND <=80.00", **ROLLING))
    assert [r[2] for r in found] == ["Unknown"]


def test_null_days_count_in_the_percentile(golden):
    ranked = stages(golden).ordered_daily.filter("hostid = 14").collect()
    assert {r.cnt for r in ranked} == {20}
    assert [r.usage_pct for r in sorted(ranked, key=lambda r: r.rn)] == [None] * 19 + [50.0]
    p95 = stages(golden).p95.filter("hostid = 14").collect()
    assert [r.p95_usage_pct for r in p95] == [None]


def test_zero_usage_is_in_no_band(golden):
    monthly = {r.hostid: r.avg_usage_pct for r in stages(golden).monthly.collect()}
    assert monthly[11] == 0.0
    for threshold in ("<=60.00", ">90.00"):
        found = disk_report(golden, TBN, threshold=threshold, **ROLLING).collect()
        assert "vm-b" not in {r.vm for r in found}


@pytest.mark.parametrize("average,band", [(60, "<=60.00"), (80, ">70.00 AND <=80.00"), (100, ">90.00")])
def test_upper_band_edge_is_inclusive(spark, average, band):
    tables = golden_tables(
        spark,
        items=[size_item(901, 15, "/e", "used"), size_item(902, 15, "/e", "free")],
        trends_uint=[(901, AS_OF - 3600, average), (902, AS_OF - 3600, 100 - average)],
    )
    found = rows_of(disk_report(tables, TBN, threshold=band, **ROLLING))
    assert ("vm-e", "/e", "Unknown", None, float(average), float(average)) in found


def test_current_audit_clocks(golden):
    found = {r.hostid: r for r in stages(golden).current_disk.collect()}
    assert (found[10].clock_used, found[10].clock_free) == (AS_OF - 7200, AS_OF - 7200)
    assert (found[14].clock_used, found[14].clock_free) == (AS_OF - 600, None)
    assert found[14].current_usage_pct is None


def test_current_of_two_zero_sides_is_null(spark):
    tables = golden_tables(
        spark, history_uint=[(111, AS_OF - 10, 0), (112, AS_OF - 10, 0)]
    )
    found = {r.hostid: r.current_usage_pct for r in stages(tables).current_disk.collect()}
    assert found[11] is None


def test_null_bucket_value_keeps_its_row(spark):
    tables = golden_tables(spark, trends_uint=[(111, AS_OF - 3600, None), (112, AS_OF - 3600, 1)])
    found = stages(tables).detail.filter(f"hostid = 11 and clock = {AS_OF - 3600}").collect()
    assert [(r.used_gib, r.usage_pct) for r in found] == [(None, None)]


def test_inspect(golden):
    assert [r.used_itemid for r in stages(golden).inspect("item_pair", hostid=10).collect()] == [101]
    assert stages(golden).inspect("detail", limit=3).count() == 3
    assert stages(golden).inspect("last_clock", itemid=101).first().max_clock == AS_OF - 7200
