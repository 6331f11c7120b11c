"""Rows are told apart, whatever frame they come from, and columns come back as they were."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import exact_dedup, near_dedup, repeats
from fleetgauge.llm.shared import located

TEXTS = ["one text here " * 30, "another text there " * 30, "third of them all " * 30]


@pytest.fixture
def files(spark, tmp_path):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, `_metadata` string, `__at` string").write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def frames(spark, files):
    plain = files.drop("_metadata", "__at")
    twice = plain.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return {
        "plain": (plain, 3),
        "filtered": (plain.filter("doc_id < 2").select("text", "doc_id"), 2),
        "exploded": (twice, 3),
        "exploded_again": (twice.withColumn("more", F.explode(F.sequence(F.lit(1), F.lit(2)))), 3),
        "joined": (plain.join(spark.range(2).withColumnRenamed("id", "other")), 3),
        "union": (plain.unionByName(plain), 3),
        "own_names": (files, 3),
        "session": (spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string"), 3),
    }


def test_every_row_has_its_place(spark, files):
    for name, (df, _) in frames(spark, files).items():
        places = located(df).select("__at")
        assert places.distinct().count() == df.count(), name


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, near_dedup.drop_near_copies])
def test_one_row_of_each_text_stays(spark, files, drop):
    some = {k: v for k, v in frames(spark, files).items() if drop is exact_dedup.drop_copies or k in ("exploded", "own_names")}
    for name, (df, texts) in some.items():
        kept = drop(df)
        assert kept.columns == df.columns, name
        assert kept.count() == texts == kept.select("text").distinct().count(), name
        assert kept.exceptAll(df).isEmpty(), name


def test_repeats_within_and_across_exploded_rows(spark, files):
    exploded = frames(spark, files)["exploded"][0]
    rows = repeats.remove_repeats(exploded).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(rows) == 6 and all(r.n_bytes == r.n_removed for r in rows)
    own = repeats.remove_repeats(files).count()
    assert own == 3


def test_sampled_rows_are_the_same_in_every_read(spark, files):
    df = files.drop("_metadata", "__at").filter(F.rand() < 0.5)
    assert "rand" not in located(df)._jdf.queryExecution().analyzed().toString()
