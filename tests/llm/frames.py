"""Small frames for the text operators, with rows that are easy to get wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORDS = "the quick brown fox jumps over a lazy dog while seven old friends sing long songs at the river bank".split()
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(20_000))

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One"),
    (5, " ".join(WORDS)),
    (6, " ".join(WORDS)),
    (6, " ".join(WORDS)),
    (7, " ".join(WORDS).upper()),
    (8, LONG),
    (9, "日本語 café — naïve İstanbul \U0001f600"),
    (None, "no id"),
    (None, None),
]


def documents(spark: SparkSession, rows=ODD_TEXTS) -> DataFrame:
    """``rows`` of (doc_id, text), with other columns whose names clash with inner ones."""
    wide = [(i, t, "en", None, None if t is None else len(t), "x", 7, 0.5) for i, t in rows]
    return spark.createDataFrame(
        wide,
        "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int, score double",
    )


def as_tuples(df: DataFrame, *columns: str) -> list[tuple]:
    rows = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in rows.collect()), key=str)
