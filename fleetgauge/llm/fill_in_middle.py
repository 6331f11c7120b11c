"""Fill-in-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of ``FRAME_BYTES`` with the units (lines), code
points and bytes before each of them. To cut a text between two units only the frame that holds
the cut is decompressed; sections and digests stream the frames in order, one at a time, so that
a worker holds one frame of a text in the clear, and its compressed frames. The output is stored
the same way, and the text is rebuilt from the output and its form alone.

A unit is a line with its line feed, or the rest after the last one. The places of the cuts and
the form depend on the document's id only (``numbers``), so a lost task gives the same rows again.

Defined cases: a null text is the empty text; empty texts and texts that contain a mark are left
as they are (form ``plain``, no section lengths). A null id counts as empty text in the hash.
Repeated rows give repeated rows. A cut may fall on either end, and both on the same place: the
section is empty then. Very long texts are whole. Other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Clear bytes of a frame; the last one of a text may be shorter.
FRAME_BYTES = 64 << 10
LEVEL = 1

#: The marks before prefix, suffix and middle, and the start of the hashed text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "7:"

#: Percentages of documents that are transformed, and of those the ones with the suffix first.
RATE = 100
SUFFIX_FIRST = 50

_FRAMED = T.StructType(
    [
        T.StructField("frames", T.ArrayType(T.BinaryType())),
        T.StructField("units", T.ArrayType(T.LongType())),
        T.StructField("chars", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
    ]
)
_FRAMED_ARROW = pa.struct(
    [
        ("frames", pa.list_(pa.binary())),
        ("units", pa.list_(pa.int64())),
        ("chars", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
    ]
)


class Frames:
    """A stored text: its frames, and the units, code points and bytes before each and in all."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], sizes: list[int]):
        self.frames, self.units, self.chars, self.sizes = frames, units, chars, sizes

    @classmethod
    def of(cls, pieces: Iterable[bytes], frame_bytes: int = FRAME_BYTES) -> Frames:
        """Store the text that the pieces make together."""
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        frames, units, chars, sizes = [], [0], [0], [0]
        last = b""

        def add(data: bytes) -> None:
            nonlocal last
            codes = np.frombuffer(data, np.uint8)
            frames.append(press(data))
            units.append(units[-1] + data.count(b"\n"))
            chars.append(chars[-1] + int(np.count_nonzero((codes & 0xC0) != 0x80)))
            sizes.append(sizes[-1] + len(data))
            last = data[-1:]

        rest = bytearray()
        for piece in pieces:
            for at in range(0, len(piece), frame_bytes):
                rest += piece[at : at + frame_bytes]
                while len(rest) >= frame_bytes:
                    add(bytes(rest[:frame_bytes]))
                    del rest[:frame_bytes]
        if rest:
            add(bytes(rest))
        if last not in (b"", b"\n"):
            units[-1] += 1
        return cls(frames, units, chars, sizes)

    @property
    def size(self) -> int:
        return self.sizes[-1]

    def _clear(self, frame: int) -> bytes:
        length = self.sizes[frame + 1] - self.sizes[frame]
        return zstandard.ZstdDecompressor().decompress(self.frames[frame], max_output_size=length)

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the text's unit of this number; at most one frame is decompressed."""
        if unit <= 0:
            return 0, 0
        if unit >= self.units[-1]:
            return self.size, self.chars[-1]
        # The frame in which the unit before ends.
        frame = bisect_right(self.units, unit - 1) - 1
        data = self._clear(frame)
        feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        end = int(feeds[unit - self.units[frame] - 1]) + 1
        codes = np.frombuffer(data, np.uint8, end)
        return self.sizes[frame] + end, self.chars[frame] + int(np.count_nonzero((codes & 0xC0) != 0x80))

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame by frame."""
        end = self.size if end is None else end
        frame = bisect_right(self.sizes, start) - 1
        while start < end:
            at = self.sizes[frame]
            data = self._clear(frame)[start - at : end - at]
            yield data
            start, frame = start + len(data), frame + 1

    def find(self, mark: bytes, start: int) -> int:
        """Place of the first ``mark`` from ``start`` on, also across frames; -1 if there is none."""
        tail = b""
        for data in self.stream(start):
            found = (tail + data).find(mark)
            if found >= 0:
                return start - len(tail) + found
            start += len(data)
            tail = (tail + data)[-len(mark) + 1 :]
        return -1

    def as_row(self) -> dict:
        return {"frames": self.frames, "units": self.units, "chars": self.chars, "sizes": self.sizes}


def arranged(text: Frames, form: str, low: int, high: int) -> Iterator[bytes]:
    """The output in this form of a text that is cut at the bytes ``low`` and ``high``."""
    if form == "plain":
        yield from text.stream()
        return
    ends = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, text.size)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark.encode()
        yield from text.stream(*ends[mark])


def rebuilt(output: Frames, form: str) -> Iterator[bytes]:
    """The text, from its output and form: the marks are the first ones, no section holds any."""
    if form == "plain":
        yield from output.stream()
        return
    second = (SUFFIX if form == "psm" else PREFIX).encode()
    one = output.find(second, 0)
    two = output.find(MIDDLE.encode(), one)
    width = len(second)
    first, last = (width, one), (one + width, two)
    prefix, suffix = (first, last) if form == "psm" else (last, first)
    for section in (prefix, (two + width, output.size), suffix):
        yield from output.stream(*section)


def _digest(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


@F.arrow_udf(_FRAMED)
def _stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        texts = column.cast(pa.binary())
        rows = (texts[i].as_py() or b"" for i in range(len(texts)))
        yield pa.array([Frames.of([text]).as_row() for text in rows], _FRAMED_ARROW)


_ARRANGED = T.StructType(
    [
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", _FRAMED),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
    ]
)
_ARRANGED_ARROW = pa.struct(
    [
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", _FRAMED_ARROW),
        ("output_sha256", pa.string()),
        ("restored_sha256", pa.string()),
    ]
)


def _arranged_row(text: Frames, form: str, low: int, high: int) -> dict:
    (low_at, low_chars), (high_at, high_chars) = text.cut(low), text.cut(high)
    output = Frames.of(arranged(text, form, low_at, high_at))
    plain = form == "plain"
    return {
        "prefix_chars": None if plain else low_chars,
        "middle_chars": None if plain else high_chars - low_chars,
        "output": output.as_row(),
        "output_sha256": _digest(output.stream()),
        "restored_sha256": _digest(rebuilt(output, form)),
    }


@F.arrow_udf(_ARRANGED)
def _arranged(
    batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]],
) -> Iterator[pa.Array]:
    for framed, form, low, high in batches:
        rows = [
            _arranged_row(Frames(**framed[i].as_py()), form[i].as_py(), low[i].as_py(), high[i].as_py())
            for i in range(len(framed))
        ]
        yield pa.array(rows, _ARRANGED_ARROW)


@F.arrow_udf(T.StringType())
def output_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The text of a stored ``output`` column."""
    for framed in batches:
        rows = (Frames(**framed[i].as_py()) for i in range(len(framed)))
        yield pa.array([b"".join(row.stream()).decode() for row in rows], pa.string())


def numbers(doc_id: Column, salt: str = SALT) -> list[Column]:
    """Four numbers below 2 ** 32 that depend on the id alone."""
    text = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``marked`` (whether the text holds a mark) and ``framed``, its stored text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return docs.select("doc_id", marked.alias("marked"), _stored(F.col("text")).alias("framed"))


def fill_in_middle(docs: DataFrame, *, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: its form, the sections' code points, the stored output, digests.

    ``rate`` percent of the documents are transformed, ``suffix_first`` percent of them with the
    suffix before the prefix. ``output_text`` gives the output's text.
    """
    h1, h2, h3, h4 = numbers(F.col("doc_id"))
    n = F.element_at("framed.units", -1)
    form = (
        F.when(F.col("marked") | (n == 0) | (h3 % 100 >= rate), "plain")
        .when(h4 % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    one, two = h1 % (n + 1), h2 % (n + 1)
    cut = stored(docs).select(
        "doc_id",
        n.alias("n"),
        form.alias("form"),
        F.least(one, two).alias("low"),
        F.greatest(one, two).alias("high"),
        "framed",
    )
    return cut.select("doc_id", "n", "form", _arranged("framed", "form", "low", "high").alias("a")).select(
        "doc_id", "n", "form", "a.*"
    )
