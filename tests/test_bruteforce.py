"""The whole report in plain Python, from the source rows, without a query engine."""

import math
import re
from collections import defaultdict
from datetime import datetime, timezone
from fractions import Fraction

import pyarrow.parquet as pq
import pytest

from fleetgauge import SCOPES, Stages, all_bands_report, resolve_window
from fleetgauge.catalogue import AS_OF, ROLLING
from fleetgauge.sources.lens import lens

EPOCH = datetime(1970, 1, 1)
TIERS = re.compile("SAP|01_Critical|02_Very High|03_High|04_Medium|05_Low")
GROUPS = [
    "TBN App", "TBN DB", "TBN SAP", "01_Critical", "TBN 01-Critical", "02_Very High", "03_High",
    "04_Medium", "05_Low", "TBN Web", "Other",
]
PREFIXES = {7: "tbn-com-hp", 9: "VC02 - tbn-com-lnv", 13: "tbn-com-mdm", 16: "VC02 - tbn-mgt-lnv"}


def rows(sf, table):
    return pq.read_table(f"/root/testdata/sf{sf}/{table}.parquet").to_pylist()


class Fleet:
    """The lens tables as dictionaries."""

    def __init__(self, sf):
        names = {r["n_nationkey"]: GROUPS[r["n_nationkey"] % 11] for r in rows(sf, "nation")}
        self.hosts, self.groups = {}, {}
        for r in rows(sf, "supplier"):
            key, home = r["s_suppkey"], r["s_nationkey"]
            prefix = PREFIXES.get(key % 20, "vm-")
            self.hosts[key] = f"{prefix}{key}"
            self.groups[key] = {names[home], names[(home + key) % 25]}
        self.samples = defaultdict(list)
        kinds = {"click": 1, "view": 2, "purchase": 3, "signup": 4}
        for r in rows(sf, "events"):
            host, k = r["user_id"] // 4, kinds.get(r["event_type"], 5)
            clock = math.floor((r["ts"] - EPOCH).total_seconds()) + (host % 3 - 1) * 1728000
            value = math.floor(r["value"]) % 4 if k == 5 else math.floor(r["value"] * 100) * 10737418
            if k in (1, 3):
                value *= (1, 2, 4, 8, 40)[host % 5]
            self.samples[host, k].append((clock, value))

    def pairs(self):
        """Host and filesystem to the item numbers of its used and free side."""
        found = {}
        for host in {h for h, _ in self.samples}:
            old = "legacy.fs.size[" if host % 17 == 3 else ""
            for path, used, free in (("/", 1, 2), ("/data", 3, 4)):
                renamed = path == "/data" and host % 13 == 5
                if (host, used) in self.samples and (host, free) in self.samples and not renamed:
                    name = old + path if path == "/data" else path
                    found[host, name] = (used, free)
        return found

    def buckets(self, host, k):
        found = {}
        for clock, value in self.samples[host, k]:
            value = 0 if host % 11 == 4 and clock % 172800 < 86400 else value
            start = clock - clock % 21600
            found[start] = max(value, found.get(start, 0))
        return found

    def in_scope(self, scope):
        for host, name in self.hosts.items():
            groups = self.groups[host]
            if name.startswith(("tbn-com-hp", "tbn-com-mdm", "VC02 - tbn-com-lnv", "VC02 - tbn-mgt-lnv")):
                continue
            if scope == "tbn":
                chosen = any("TBN" in g and "SAP" not in g for g in groups)
            elif scope == "critical":
                chosen = any(re.search("01.Critical", g) and "SAP" not in g for g in groups)
            else:
                chosen = any("TBN" in g for g in groups) and not any(TIERS.search(g) for g in groups)
            if chosen:
                yield host, name

    def latest(self, host, k, since, until=math.inf):
        return max((s for s in self.samples.get((host, k), ()) if since <= s[0] < until), default=None)


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def share(part, rest):
    return Fraction(part * 100, part + rest) if part + rest else None


def expected_report(fleet, scope):
    found, pairs = [], fleet.pairs()
    for host, name in fleet.in_scope(scope):
        for path in ("/", "/data", "legacy.fs.size[/data"):
            if (host, path) not in pairs:
                continue
            used, free = (fleet.buckets(host, k) for k in pairs[host, path])
            days = defaultdict(list)
            for clock in used.keys() & free.keys():
                if AS_OF - 30 * 86400 <= clock < AS_OF:
                    label = datetime.fromtimestamp(clock, timezone.utc).date()
                    days[label].append(share(used[clock], free[clock]))
            daily = [mean(values) for values in days.values()]
            average = mean(daily)
            if average is None or not 0 < average <= 100:
                continue
            daily.sort(key=lambda v: (v is not None, v or 0))
            p95 = daily[math.ceil(len(daily) * Fraction(95, 100)) - 1]
            now = [fleet.latest(host, k, AS_OF - 21600) for k in pairs[host, path]]
            current = share(now[0][1], now[1][1]) if all(now) else None
            power = fleet.latest(host, 5, AS_OF - 3600, AS_OF)
            state = {0: "Powered Off", 1: "Powered On", 2: "Suspended"}.get(power and power[1], "Unknown")
            found.append((name, path, state, current, average, p95))
    return found


def plain(row):
    return tuple(None if v is None else v if isinstance(v, str) else round(float(v), 6) for v in row)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("scope", sorted(SCOPES))
def test_report(spark, sf, scope):
    expected = sorted(map(plain, expected_report(Fleet(sf), scope)), key=str)
    tables = lens(spark, f"/root/testdata/sf{sf}")
    found = all_bands_report(tables, SCOPES[scope], **ROLLING).drop("band").collect()
    found = sorted(map(plain, found), key=str)
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    for one, other in zip(found, expected):
        assert one[3:] == pytest.approx(other[3:], abs=1e-5)


def test_properties(spark):
    tables = lens(spark, "/root/testdata/sf0.01")
    window = resolve_window(**ROLLING)
    stages = {name: Stages(tables, policy, window, AS_OF) for name, policy in SCOPES.items()}

    def hosts(name):
        return {r.hostid for r in stages[name].list_server.collect()}

    assert hosts("unprioritized") < hosts("tbn")

    tbn = stages["tbn"]
    days = defaultdict(list)
    for r in tbn.daily.collect():
        assert r.usage_pct is None or 0 <= r.usage_pct <= 100
        days[r.hostid, r.partition_name].append(r.usage_pct)
    for r in tbn.p95.collect():
        values = days[r.hostid, r.partition_name]
        assert r.p95_usage_pct in values
        if None not in values:
            assert r.p95_usage_pct >= sorted(values)[len(values) // 2]
    assert any(None in values for values in days.values())

    monthly = {(r.vm_name, r.partition_name): r.avg_usage_pct for r in tbn.monthly.collect()}
    report = all_bands_report(tables, SCOPES["tbn"], **ROLLING).collect()
    assert report
    for r in report:
        assert monthly[r.vm, r.partition_name] == pytest.approx(r.average_disk_pct)
    order = [(-r.average_disk_pct, r.vm, r.partition_name) for r in report]
    assert order == sorted(order)
