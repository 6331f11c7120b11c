"""Helpers of the text operators: shared storage, size-checked joins, bytes of a text."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to every executor only if its measured size is at most this.
BROADCAST_BYTES = 32 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: ``bytes.translate`` table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Word of a text lower-cased in A-Z: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetgauge-llm-")


def reachable(spark: SparkSession) -> None:
    """Python workers started from now on also look for this package where the driver found it.

    On a cluster that has it elsewhere (``--py-files``) this changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Only a local session that names none, as in tests, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _test_folder()
    return f"{base.rstrip('/')}/llm-{uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later plans start from its files."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a plan may hold whose rows are rows of files, each at most once.
_PLAIN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}
_TAKEN = ("__at", "_metadata")


def _plain(docs: DataFrame) -> bool:
    """Whether every row is one row of a file, and the same one whenever it is read."""
    todo = [docs._jdf.queryExecution().analyzed()]
    if not todo[0].deterministic():
        return False
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _PLAIN:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def _inner_names(columns: list[str]) -> list[str]:
    """``columns`` with other names for those that ``located`` needs itself."""
    free = "__own"
    while any(c.lower().startswith(free) for c in columns):
        free += "_"
    return [f"{free}{i}" if c.lower() in _TAKEN else c for i, c in enumerate(columns)]


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__at`` that tells its rows apart: the file and place of each.

    A frame whose rows aren't those of files one by one, as after a join or an explode, is
    written first. Columns with a name that is needed here get another one until ``restored``.
    """
    where = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    names = _inner_names(docs.columns)
    if names == docs.columns and _plain(docs):
        try:
            return docs.withColumn("__at", where)
        except AnalysisException:
            # A source without places, such as rows that the session holds.
            pass
    return keep(docs.toDF(*names)).withColumn("__at", where)


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were, from rows that ``located`` made of it."""
    names = _inner_names(docs.columns)
    return rows.select(*[F.col(f"`{inner}`").alias(own) for inner, own in zip(names, docs.columns, strict=True)])


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Python workers get at most ``most`` rows at once from what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all of ``df``'s rows, at ``row_bytes`` each, may go to every executor."""
    return df.count() * row_bytes <= limit


def checked_join(
    large: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str,
    row_bytes: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join to a kept table that is broadcast if it was counted to be small.

    Beyond the limit both sides are shuffled; Spark then splits skewed keys.
    """
    if fits(small, row_bytes, limit):
        return large.join(F.broadcast(small), on, how)
    return large.join(small.hint("shuffle_merge"), on, how)


def lower_ascii(column: Column) -> Column:
    """``column`` with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), divisor)


def text_rows(batches: Iterator, most: int = 8 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Arrow batches of (id, text) as ids and UTF-8 texts of about ``most`` bytes.

    Null texts are empty. A text longer than ``most`` comes alone.
    """
    ids: list = []
    texts: list[bytes] = []
    size, kind = 0, None
    for batch in batches:
        kind = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            if ids and size + len(data) > most:
                yield pa.array(ids, kind), texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(data)
            size += len(data)
    if ids:
        yield pa.array(ids, kind), texts


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1) modulo 2 ** 64; the longest asked for is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        known = np.full(max(count, 1), base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:count]
