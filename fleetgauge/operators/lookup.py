"""Join a large table to a smaller one without trusting the smaller one's size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024

# Bits of a row filter per wanted key, and the most words of 64 bits it has: 8 MB whatever the data.
FILTER_BITS = 32
FILTER_WORDS = 1 << 20

_TEXT = (T.StringType, T.BinaryType)
_FIXED_WIDTH = 8


def _row_bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        parts = [_row_bytes(column[field.name], field.dataType) for field in kind.fields]
        return reduce(lambda total, part: total + part, parts)
    if isinstance(kind, _TEXT):
        return F.coalesce(F.octet_length(column), F.lit(0)) + _FIXED_WIDTH
    if isinstance(kind, (T.ArrayType, T.MapType)):
        raise ValueError(f"no size bound for a {kind.simpleString()} column")
    return F.lit(_FIXED_WIDTH)


def data_bytes(schema: T.StructType) -> Column:
    """Aggregate: the data size of rows with ``schema``."""
    columns = F.struct(*[F.col(name) for name in schema.names])
    return F.sum(_row_bytes(columns, schema).cast("long"))


def measured_bytes(df: DataFrame) -> int:
    """Data size of ``df``, counted by one aggregate job over it."""
    return df.agg(data_bytes(df.schema).alias("bytes")).first()["bytes"] or 0


def measured_together(frames: list[DataFrame]) -> list[int]:
    """Data sizes of several tables, counted by one aggregate job over all."""
    def rows(i: int, df: DataFrame) -> DataFrame:
        columns = F.struct(*[F.col(name) for name in df.columns])
        return df.select(F.lit(i).alias("i"), _row_bytes(columns, df.schema).cast("long").alias("bytes"))

    every = reduce(DataFrame.unionByName, [rows(i, df) for i, df in enumerate(frames)])
    found = {r["i"]: r["bytes"] for r in every.groupBy("i").agg(F.sum("bytes").alias("bytes")).collect()}
    return [found.get(i, 0) for i in range(len(frames))]


def within_limit(size: int, limit: int | None = None) -> bool:
    """Whether ``size`` bytes may be sent to every executor."""
    return size <= (BROADCAST_BYTES if limit is None else limit)


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` is measured to be small enough to send to every executor."""
    return within_limit(measured_bytes(df), limit)


def sized(df: DataFrame, small: bool) -> DataFrame:
    """``df`` marked for broadcast where it was measured to be small."""
    return F.broadcast(df) if small else df


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: str | list[str], *, small: bool, how: str = "inner"
) -> DataFrame:
    """Join every row of ``facts`` to its matches in ``lookup``.

    A lookup that was measured to be ``small`` (see ``fits_broadcast``) is
    broadcast and ``facts`` does not move. Any other meets the facts in a
    shuffled merge join, where adaptive execution splits the rows of a hot key
    over many tasks as their size asks for. The hint keeps Spark from
    broadcasting on an estimate.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot split the facts of a {how} join")
    return facts.join(F.broadcast(lookup) if small else lookup.hint("shuffle_merge"), on, how)


def _places(key: Column, words: int) -> list[tuple[Column, Column]]:
    """Word and bit of a key under two hashes."""
    found = []
    for seed in (0, 1):
        hashed = F.xxhash64(key, F.lit(seed))
        bit = F.pmod(F.shiftright(hashed, 32), F.lit(64)).cast("int")
        found.append((F.pmod(hashed, F.lit(words)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    return found


def thinned(facts: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """``facts`` without most of the rows whose key ``wanted`` lacks, before anything moves.

    The wanted keys, counted by one job, set bits of a filter that reaches the scans as one
    value of a bounded size. Few rows pass it wrongly, so the join that decides still follows.
    """
    wanted = wanted.select(F.col(on).cast(facts.schema[on].dataType))
    count = wanted.count()
    words = min(FILTER_WORDS, 1 << (count * FILTER_BITS // 64).bit_length())
    keys = wanted.select(F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bits")) for w, b in _places(F.col(on), words)])).alias("p"))
    every = wanted.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    table = keys.select("p.word", "p.bits").unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    bits = table.agg(F.transform(in_order, lambda s: s["bits"]).alias("bits")).scalar()
    passes = [F.get(bits, word).bitwiseAND(bit) != 0 for word, bit in _places(F.col(on), words)]
    return facts.filter(reduce(lambda one, other: one & other, passes))
