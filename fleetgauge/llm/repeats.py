"""Repeated passages by column-wise construction over many documents.

A 200-byte string (a window) that starts anywhere else too, in the same text or another, is
removed wherever it stands. Suffix order finds equal windows, built column by column as the
Burrows-Wheeler transform of a collection is: each round puts one symbol in front of the
suffix of every member, reorders the suffixes by that symbol (the round's part of the
transform, read in the order so far), and updates the common prefixes of neighbours. Windows
whose neighbours have a common prefix of 200 bytes are repeated.

The collections are made so that rounds are few and can run anywhere. Every window has an
anchor, the 100-byte string in it with the least hash (of equal ones the first), so equal
windows have equal anchors at equal places. Windows in a row with one anchor are a segment.
Anchors are counted first, and only segments whose anchor occurs twice are moved, dealt by
anchor. A task takes whole anchors until it has some MB, lays the members' anchors in the
same columns, and does the rounds, 300 at most. Suffixes of different rounds can't be equal
windows then, so that the parts of earlier rounds are not kept: memory is bounded by the block.

Equal texts are one member: every window of theirs is repeated. An anchor with very many
segments is not given to one task: its windows are counted by 128-bit digests instead.

Defined cases: a null text is empty. Texts under 200 bytes lose nothing. Windows never cross
texts; they are judged on the input. Repeated rows are equal texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.shared import BROADCAST_BYTES, checked_join, keep, located, powers

WINDOW = 200
MER = 100
#: Places of the anchor in a window.
SPREAD = WINDOW - MER + 1
#: Segments of one anchor that are built together; beyond, windows are counted by digests.
TOGETHER = 16_000
#: Bytes of segments in one construction.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20

_PLACE_BITS = 28
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(base, -1, 1 << 64) for base in _BASES)
_VALUES = np.random.default_rng(31).integers(1, 1 << 63, (2, 256), np.uint64)

_SEGMENT = T.StructType(
    [
        T.StructField("anchor", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
_SEGMENT_ARROW = pa.struct([("anchor", pa.int64()), ("start", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])


def _rolling(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes from every place."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * powers(_BASES[which], n), out=sums[1:])
    out = sums[size:] - sums[: n - size + 1]
    out *= powers(_INVERSES[which], n)[: n - size + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of ``size`` values from every place."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Runs:
    """Runs of windows with one anchor, over texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"".join(texts)
        data = np.frombuffer(self.joined, np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.offset = np.cumsum(lengths) - lengths
        empty = np.empty(0, np.int64)
        self.first, self.last, self.place, self.row, self.anchor = empty, empty, empty, empty, empty
        if len(data) < WINDOW:
            return
        if len(data) >= 1 << _PLACE_BITS:
            raise ValueError("a text of 256 MB or more")
        hashes = _rolling(data, MER)
        ranked = hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)
        ranked |= np.arange(len(hashes), dtype=np.uint64)
        place = (_least(ranked, SPREAD) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        # Windows that cross into the next text aren't any.
        count = np.maximum(lengths - WINDOW + 1, 0)
        real = np.zeros(len(place) + 1, np.int64)
        some = count > 0
        np.add.at(real, self.offset[some], 1)
        np.add.at(real, (self.offset + count)[some], -1)
        windows = np.flatnonzero(np.cumsum(real[:-1]))
        if not len(windows):
            return
        where = place[windows]
        new = np.r_[True, (where[1:] != where[:-1]) | (windows[1:] != windows[:-1] + 1)]
        heads = np.flatnonzero(new)
        self.first = windows[heads]
        self.last = windows[np.r_[heads[1:], len(windows)] - 1]
        self.place = where[heads]
        self.row = np.searchsorted(self.offset, self.first, side="right") - 1
        self.anchor = hashes[self.place].view(np.int64)

    def per_text(self) -> np.ndarray:
        """Number of the first run of each text, and of the run after all."""
        return np.r_[np.searchsorted(self.first, self.offset), len(self.first)]


def _shards(texts: list[bytes]) -> Iterator[list[bytes]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > SHARD_BYTES:
            yield texts[start:at]
            start, size = at, 0
        size += len(text)
    if texts:
        yield texts[start:]


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _anchors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        out = []
        for texts in _shards(_bytes(column)):
            runs = Runs(texts)
            cut = runs.per_text()
            out += [runs.anchor[cut[i] : cut[i + 1]] for i in range(len(texts))]
        yield pa.array(out, pa.list_(pa.int64()))


def _wanted(runs: Runs, known: np.ndarray | None, given: list) -> np.ndarray:
    """Which runs have an anchor that occurs more than once."""
    if known is not None:
        at = np.minimum(np.searchsorted(known, runs.anchor), max(len(known) - 1, 0))
        return known[at] == runs.anchor if len(known) else np.zeros(len(runs.anchor), bool)
    cut = runs.per_text()
    parts = [np.isin(runs.anchor[cut[i] : cut[i + 1]], np.array(own or [], np.int64)) for i, own in enumerate(given)]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def _segments(shipped):
    """Segments of each text with a wanted anchor; ``shipped`` broadcasts them, else each row has its own."""

    @F.arrow_udf(T.ArrayType(_SEGMENT))
    def segments(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = None if shipped is None else shipped.value
        for column, given in batches:
            texts, own, done = _bytes(column), given.to_pylist() if known is None else [], 0
            out: list[list[dict]] = []
            for shard in _shards(texts):
                runs = Runs(shard)
                kept = np.flatnonzero(_wanted(runs, known, own[done : done + len(shard)]))
                done += len(shard)
                found: list[list[dict]] = [[] for _ in shard]
                for i in kept.tolist():
                    first, row = int(runs.first[i]), int(runs.row[i])
                    found[row].append(
                        {
                            "anchor": int(runs.anchor[i]),
                            "start": first - int(runs.offset[row]),
                            "at": int(runs.place[i]) - first,
                            "data": runs.joined[first : int(runs.last[i]) + WINDOW],
                        }
                    )
                out += found
            yield pa.array(out, pa.list_(_SEGMENT_ARROW))

    return segments


def repeated_in_block(group: np.ndarray, at: np.ndarray, data: list[bytes]) -> np.ndarray:
    """For every segment, which of its windows (by the window's place) another window equals.

    ``group`` numbers the segments' anchors, ``at`` is the anchor's place in each segment.
    """
    k = len(data)
    left, right = SPREAD - 1, WINDOW
    # One row per column; the anchors begin in the same column, 0 stands for no byte.
    columns = np.zeros((left + right, k), np.uint16)
    for i, segment in enumerate(data):
        start = left - int(at[i])
        columns[start : start + len(segment), i] = np.frombuffer(segment, np.uint8)
        columns[start : start + len(segment), i] += 1
    order = np.argsort(group, kind="stable")
    # Common prefix with the suffix before in order, WINDOW at most; other anchors have none.
    shared = np.zeros(k, np.uint8)
    ranked = group[order]
    border = np.r_[True, ranked[1:] != ranked[:-1]]
    number = np.cumsum(border) - 1
    if number[-1] < 1 << 16:
        number = number.astype(np.uint16)
    found = np.zeros((k, SPREAD), bool)
    for column in range(left + right - 1, -1, -1):
        symbol = columns[column][order]
        by_symbol = np.argsort(symbol, kind="stable")
        moved = by_symbol[np.argsort(number[by_symbol], kind="stable")]
        least = _range_minima(shared, moved)
        now = symbol[moved]
        same = np.zeros(k, bool)
        same[1:] = (now[1:] == now[:-1]) & (now[1:] > 0) & ~border[1:]
        shared = np.where(same, np.minimum(least, WINDOW - 1) + 1, 0).astype(np.uint8)
        order = order[moved]
        if column < SPREAD:
            equal = np.flatnonzero(shared >= WINDOW)
            if len(equal):
                for member in (order[equal], order[equal - 1]):
                    found[member, column - left + at[member]] = True
    return found


def _range_minima(values: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Least of ``values`` after the old place of each suffix's new predecessor, up to its own."""
    low, high = moved[:-1] + 1, moved[1:]
    span = high - low + 1
    out = np.zeros(len(moved), values.dtype)
    ahead = span > 0
    if not ahead.any():
        return out
    low, high, span = low[ahead], high[ahead], span[ahead]
    level = np.frexp(span.astype(np.float64))[1] - 1
    least = np.empty(len(span), values.dtype)
    table, width = values, 1
    for step in range(int(level.max()) + 1):
        mine = level == step
        least[mine] = np.minimum(table[low[mine]], table[high[mine] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    out[1:][ahead] = least
    return out


def _spans(starts: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Spans of bytes that windows at ``starts`` cover, when they lie close together."""
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return [(base + int(p[0]), base + int(p[-1]) + WINDOW) for p in np.split(starts, cut)]


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor to the spans of their repeated windows; whole anchors in each block."""
    held: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        anchors, texts, starts, ats, data = zip(*held, strict=True)
        group = np.unique(np.array(anchors, np.int64), return_inverse=True)[1].reshape(-1)
        found = repeated_in_block(group, np.array(ats, np.int64), list(data))
        rows = [
            (texts[i], span[0], span[1])
            for i in np.flatnonzero(found.any(axis=1)).tolist()
            for span in _spans(np.flatnonzero(found[i]), starts[i])
        ]
        keys, lows, highs = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())],
            ["digest", "low", "high"],
        )

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if size > BLOCK_BYTES and row[0] != held[-1][0]:
                yield block()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield block()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def _window_digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for column in batches:
        offsets, a, b = [0], [], []
        for data in column.to_pylist():
            view = np.frombuffer(data, np.uint8)
            a.append(_rolling(view, WINDOW, 0).view(np.int64))
            b.append(_rolling(view, WINDOW, 1).view(np.int64))
            offsets.append(offsets[-1] + len(a[-1]))
        values = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(a) if a else np.empty(0, np.int64)), pa.array(np.concatenate(b) if b else np.empty(0, np.int64))],
            ["a", "b"],
        )
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(kind)


_CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


@F.arrow_udf(_CUT)
def _removed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct(
        [
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
        ]
    )
    for column, whole, marked in batches:
        out = []
        for text, all_of_it, spans in zip(_bytes(column), whole.to_pylist(), marked.to_pylist(), strict=True):
            merged = spans or []
            if all_of_it:
                merged = [[0, len(text)]] if len(text) >= WINDOW else []
            bounds = [0, *(p for span in merged for p in span), len(text)]
            kept = hashlib.sha256()
            for low, high in zip(bounds[::2], bounds[1::2], strict=True):
                kept.update(text[low:high])
            out.append(
                {
                    "n_bytes": len(text),
                    "n_removed": sum(high - low for low, high in merged),
                    "n_spans": len(merged),
                    "kept_sha256": kept.hexdigest(),
                    "spans": merged,
                }
            )
        yield pa.array(out, kind)


def _merged(spans: list[dict]) -> list[list[int]]:
    merged: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


@F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _merged_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield pa.array([_merged(spans) for spans in column.to_pylist()], pa.list_(pa.list_(pa.int64())))


def _repeated_spans(texts: DataFrame, most_known: int, together: int) -> DataFrame:
    """(digest, low, high) of repeated windows in ``texts`` (digest, text), which are all different."""
    spark = texts.sparkSession
    counted = keep(
        texts.select(F.explode(_anchors(F.col("text"))).alias("anchor"))
        .groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
    if counted.count() * 8 <= most_known:
        known = counted.select("anchor").toArrow()["anchor"].to_numpy()
        shipped = spark.sparkContext.broadcast(np.sort(known))
        asked = texts.withColumn("own", F.lit(None).cast("array<bigint>"))
    else:
        shipped = None
        own = (
            texts.select("digest", F.explode(F.array_distinct(_anchors(F.col("text")))).alias("anchor"))
            .join(counted.select("anchor").hint("shuffle_merge"), "anchor")
            .groupBy("digest")
            .agg(F.collect_list("anchor").alias("own"))
        )
        asked = texts.join(own.hint("shuffle_merge"), "digest")
    found = asked.select("digest", F.explode(_segments(shipped)(F.col("text"), F.col("own"))).alias("s"))
    segments = found.select("s.anchor", "digest", "s.start", "s.at", "s.data")
    frequent = keep(counted.filter(F.col("n") > together).select("anchor"))
    if frequent.isEmpty():
        return _constructed(segments)
    segments = keep(segments)
    rare = checked_join(segments, frequent, "anchor", "left_anti", 8)
    often = checked_join(segments, frequent, "anchor", "left_semi", 8)
    return _constructed(rare).unionByName(_counted(often))


def _counted(often: DataFrame) -> DataFrame:
    """Spans of repeated windows in segments of very frequent anchors, by counts.

    Equal segments are counted first: all windows of theirs are repeated. The windows of the
    different ones are counted by their digests, and looked up for segments that occur once.
    """
    keyed = keep(often.select("digest", "start", F.unhex(F.md5("data")).alias("segment"), "data"))
    groups = keep(
        keyed.groupBy("segment").agg(
            F.count("*").alias("n"),
            F.first("data").alias("data"),
            F.first("digest").alias("digest"),
            F.first("start").alias("start"),
        )
    )
    many = groups.filter("n > 1").select("segment")
    low, high = F.col("start").alias("low"), (F.col("start") + F.length("data")).alias("high")
    whole = keyed.join(many.hint("shuffle_merge"), "segment").select("digest", low, high)
    windows = keep(
        groups.select("n", "digest", "start", F.posexplode(_window_digests(F.col("data"))).alias("i", "w")).select(
            "n", "digest", (F.col("start") + F.col("i")).alias("low"), "w.a", "w.b"
        )
    )
    twice = windows.groupBy("a", "b").agg(F.sum("n").alias("times")).filter("times > 1").select("a", "b")
    single = (
        windows.filter("n = 1")
        .join(twice.hint("shuffle_merge"), ["a", "b"])
        .select("digest", "low", (F.col("low") + WINDOW).alias("high"))
    )
    return whole.unionByName(single)


def _constructed(segments: DataFrame) -> DataFrame:
    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_construct, "digest binary, low bigint, high bigint")


def remove_repeats(
    docs: DataFrame, *, most_known: int = BROADCAST_BYTES, together: int = TOGETHER, marked_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes).

    ``most_known`` bounds the bytes of repeated anchors that are broadcast, ``together`` the
    segments of an anchor in one construction, ``marked_bytes`` the spans that are broadcast.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = located(docs).withColumn("__digest", digest)
    keys = keep(rows.select(F.col("__digest").alias("digest"), F.col("__at").alias("at")))
    copies = keep(
        keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("stays")).filter("n > 1")
    )
    others = keep(
        keys.join(copies.hint("shuffle_merge"), "digest").filter("at <> stays").select(F.col("at").alias("__at"))
    )
    texts = checked_join(rows.select("__at", "__digest", "text"), others, "__at", "left_anti", 160).select(
        F.col("__digest").alias("digest"), "text"
    )
    spans = _repeated_spans(texts, most_known, together)
    marks = (
        spans.groupBy("digest")
        .agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        .select("digest", _merged_spans(F.col("spans")).alias("spans"))
        .join(copies.select("digest", F.lit(True).alias("copied")), "digest", "full")
        .select(
            F.col("digest").alias("__digest"),
            F.coalesce("copied", F.lit(False)).alias("whole"),
            F.when(F.col("copied").isNull(), F.col("spans")).alias("spans"),
        )
    )
    marks = keep(marks)
    size = marks.agg(F.sum(64 + 40 * F.coalesce(F.size("spans"), F.lit(0)).cast("long"))).first()[0] or 0
    marks = F.broadcast(marks) if size <= marked_bytes else marks.hint("shuffle_merge")
    joined = rows.select("doc_id", "text", "__digest").join(marks, "__digest", "left")
    cut = _removed(F.col("text"), F.coalesce("whole", F.lit(False)), F.col("spans"))
    return joined.select("doc_id", cut.alias("cut")).select("doc_id", "cut.*")
