import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge import TBN, Stages, all_bands_report, resolve_window
from fleetgauge.operators.latest import latest_per_key
from fleetgauge.operators.lookup import fits_broadcast, lookup_join, measured_bytes
from fleetgauge.operators.means import mean_of_daily_means
from fleetgauge.operators.nearest_rank import nearest_rank, rank_within, value_at_rank
from fleetgauge.operators.pairing import paired_ratio
from fleetgauge.operators.settle import settle
from fleetgauge.sources.tables import SCHEMAS, Telemetry, typed
from tests.golden import AS_OF, GIB, ROLLING, golden_tables, local_frame


def skewed(seed=1, rows=9000):
    """A third of the rows on one key, many ties, some NULLs, one all-NULL key."""
    rng = random.Random(seed)
    data = [(0, rng.randrange(400)) for _ in range(rows // 3)]
    data += [(rng.randrange(1, 40), rng.randrange(10_000)) for _ in range(rows // 2)]
    data += [(rng.randrange(0, 40), None) for _ in range(rows // 8)]
    data += [(99, None)] * 3 + [(98, 7)] + [(None, rng.randrange(50)) for _ in range(30)]
    return data


def expected_ranks(data, q):
    groups = {}
    for key, value in data:
        groups.setdefault(key, []).append(value)
    found = {}
    for key, values in groups.items():
        values.sort(key=lambda v: (v is not None, v or 0))
        found[key] = values[max(1, math.ceil(round(len(values) * q, 9))) - 1]
    return found


@pytest.mark.parametrize("q", [0, 0.5, 0.95, 1])
def test_nearest_rank_against_a_sorted_list(spark, q):
    data = skewed()
    df = local_frame(spark, data, "k long, v long").repartition(5)
    found = nearest_rank(df, ["k"], "v", q).collect()
    assert {r.k: r.percentile for r in found} == expected_ranks(data, q)
    assert len(found) == len({k for k, _ in data})


def test_nearest_rank_of_one_repeated_value(spark):
    df = local_frame(spark, [(1, 5)] * 500 + [(2, None)] * 19 + [(2, 50)], "k long, v long")
    found = {r.k: r.percentile for r in nearest_rank(df, ["k"], "v", 0.95).collect()}
    assert found == {1: 5, 2: None}


def test_nearest_rank_deals_a_hot_key_over_ranges(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    plan = nearest_rank(df, ["k"], "v", 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    values = sorted(i * 7919 % 20_011 for i in range(20_000))
    assert nearest_rank(df, ["k"], "v", 0.95).first().percentile == values[19_000 - 1]


def test_window_form_agrees_for_bounded_groups(spark):
    data = skewed(seed=2, rows=900)
    df = local_frame(spark, data, "k long, v long")
    ranked = rank_within(df, ["k"], "v").groupBy("k").agg(value_at_rank("v", 0.95).alias("p"))
    assert {r.k: r.p for r in ranked.collect()} == expected_ranks(data, 0.95)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_the_plain_join(spark, how):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    lookup = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    plain = sorted(map(str, facts.join(lookup, "k", how).collect()))
    for small in (True, False):
        joined = lookup_join(facts, lookup, "k", small=small, how=how)
        assert sorted(map(str, joined.collect())) == plain


def test_a_large_lookup_is_not_broadcast(spark):
    facts = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    joined = lookup_join(facts, spark.range(40).withColumnRenamed("id", "k"), "k", small=False)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_full_joins_are_refused(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        lookup_join(df, df, "id", small=False, how="full")


def test_measured_bytes(spark):
    df = local_frame(spark, [(1, "abc"), (2, None)], "k long, s string")
    assert measured_bytes(df) == 2 * (8 + 8) + 3
    assert measured_bytes(df.filter("k > 9")) == 0
    assert measured_bytes(df.select(F.struct("k", "s").alias("x"))) == 2 * (8 + 8) + 3
    assert fits_broadcast(df, 35) and not fits_broadcast(df, 34)
    with pytest.raises(ValueError):
        measured_bytes(df.select(F.array("k").alias("a")))


def report(tables, **options):
    rows = all_bands_report(tables, TBN, **ROLLING, **options).collect()
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]


def test_shuffled_report_equals_the_broadcast_report(lens_tables):
    expected = report(lens_tables)
    assert expected
    assert report(lens_tables, broadcast_bytes=0) == expected


def test_repeated_buckets_combine(spark):
    repeats = [(111, AS_OF - 60, 1 * GIB), (111, AS_OF - 60, 2 * GIB), (111, AS_OF - 60, 2 * GIB)]
    free = [(112, AS_OF - 60, 2 * GIB), (112, AS_OF - 60, 6 * GIB)]
    tables = golden_tables(spark, trends_uint=[*repeats, *free])
    found = Stages(tables, TBN, resolve_window(**ROLLING), AS_OF).detail
    rows = found.filter(f"clock = {AS_OF - 60}").collect()
    assert sorted((r.used_gib, r.free_gib) for r in rows) == sorted(
        (u, f) for u in (1.0, 2.0, 2.0) for f in (2.0, 6.0)
    )


def test_repeated_bucket_without_partner_is_dropped(spark):
    tables = golden_tables(spark, trends_uint=[(111, AS_OF - 60, 1), (111, AS_OF - 60, 2)])
    found = Stages(tables, TBN, resolve_window(**ROLLING), AS_OF).detail
    assert found.filter(f"clock = {AS_OF - 60}").count() == 0


def test_settled_data_is_kept_and_measured(spark):
    df = local_frame(spark, [(1, "abc"), (2, None)], "k long, s string")
    stored, size = settle(df)
    assert size == measured_bytes(df) == measured_bytes(stored)
    assert sorted(map(tuple, stored.collect())) == [(1, "abc"), (2, None)]
    stored.unpersist()
    assert sorted(map(tuple, stored.collect())) == [(1, "abc"), (2, None)]
    empty, size = settle(df.filter("k > 9"))
    assert (empty.count(), size) == (0, 0)


def test_latest_per_key_equals_the_first_ranked_row(spark):
    rng = random.Random(3)
    data = [(rng.randrange(30) if i % 3 else 0, rng.randrange(60), rng.randrange(9)) for i in range(3000)]
    data += [(77, None, 5), (78, 4, None)]
    df = local_frame(spark, data, "k long, clock long, v long")
    order = Window.partitionBy("k").orderBy(F.desc("clock"), F.desc("v"))
    in_range = df.filter((F.col("clock") >= 3) & (F.col("clock") < 50))
    ranked = in_range.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    found = latest_per_key(df, ["k"], "clock", "v", since=3, until=50)
    assert sorted(found.collect()) == sorted(ranked.collect())


def test_paired_ratio_and_mean_of_daily_means(spark):
    data = [(1, 1, 30), (1, 2, 70), (1, 1, 10), (2, 1, 5), (3, 1, 0), (3, 2, 0)]
    df = local_frame(spark, data, "k long, side long, v long")
    found = paired_ratio(df, ["k"], F.col("side") == 1, F.col("side") == 2, F.col("v")).collect()
    assert sorted(map(tuple, found)) == [(1, 40, 70, 40 / 110 * 100), (3, 0, 0, None)]
    days = local_frame(spark, [(1, 1, 10), (1, 1, 20), (1, 2, 45), (1, 3, None)], "k long, d long, v long")
    assert mean_of_daily_means(days, ["k"], "d", ["v"]).first().avg_v == 30.0


def test_decimal_sources_give_the_same_rows(spark):
    plain = golden_tables(spark)
    for name, ddl in SCHEMAS.items():
        wide = getattr(plain, name)
        for column, kind in wide.dtypes:
            if kind == "bigint":
                wide = wide.withColumn(column, F.col(column).cast("decimal(20,0)"))
        wide.createOrReplaceTempView(f"wide_{name}")
    tables = Telemetry(**{name: typed(spark.table(f"wide_{name}"), name) for name in SCHEMAS})
    window = resolve_window(**ROLLING)
    found, expected = (Stages(t, TBN, window, AS_OF).detail for t in (tables, plain))
    assert found.dtypes == expected.dtypes
    assert sorted(found.collect()) == sorted(expected.collect())
    with pytest.raises(ValueError, match="key_"):
        typed(plain.items.drop("key_"), "items")
