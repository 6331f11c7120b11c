"""Packing documents into sequences: shortest pack first over the histogram of lengths.

Every text is tokenised once; its ids and a closing id are cut into pieces of at most a
sequence's length, and the pieces (without their ids) are kept as a table. Only the histogram
of piece lengths, one row per length, reaches the driver. There the lengths are placed longest
first: as many pieces of a length as possible go into the pack that is shortest so far, if it
has room, and the counts of packing patterns are updated. Each pattern gets a run of
sequences. The patterns are joined back by rank: the pieces of a length are numbered, salted
so that no length is ranked by one task, and the ranks of a length map to sequences and
offsets.

Defined cases: a null or empty text has the closing id alone. Documents longer than a sequence
are cut at multiples of its length. Repeated rows are packed one by one. Other columns are
ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.shared import checked_join, keep, powers

LENGTH = 4096
#: Pieces of one length and salt that a task ranks, on average at most.
RANKED = 20_000
LEAST_SALTS = 256

#: Most words whose ids a Python worker remembers, over tasks.
REMEMBERED = 400_000
#: Characters of texts that are encoded together.
TOGETHER = 2 << 20

_PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>"
_ARROW = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
)


_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 0x180, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Kinds of the first 384 characters of Unicode: white space, letter, number, other.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.array(
    [
        _SPACE if c.isspace() else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)
        for c in map(chr, range(0x180))
    ]
)
#: The endings that the vocabulary's pattern cuts off with their apostrophe.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


class Tokenizer:
    """Ids of texts by a vocabulary file of ``tokenizers``, with its words' ids remembered.

    Whether the file's rules (NFC, white space, lower case, then cutting by a pattern) are the
    known ones is told by a probe text. If so, texts of the first 384 characters of Unicode, on
    which each rule works character by character, are cut here with numpy, and only words that
    are new to this worker are encoded. All other texts, and all texts of another file, are
    encoded whole. Words are remembered by 64-bit hashes.
    """

    #: Marks of special tokens, and white space that isn't alike here and there.
    _MARKS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    #: Characters whose cutting or case isn't sure to be alike.
    _FAR = re.compile("[\u0130\u0180-\U0010ffff]")
    _PROBE = "It's  WE'LL ÀÉñ²3x!?'s\n\xa0ŒUVRE's--42 ,q'd ''t 'tis Ŀ·l´ '"

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Loaded
        from tokenizers import normalizers, pre_tokenizers

        self.loaded = Loaded.from_file(path)
        self.words = Loaded.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[int, bytes] = {}
        self.by_word = bool(np.array_equal(self._by_word([self._PROBE])[0], self._whole(self._PROBE)))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.loaded.encode(text, add_special_tokens=False).ids, "<u4")

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        lowered = [text.lower() for text in texts]
        joined = " ".join(lowered)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begin, end = _cut(joined, chars)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_VALUE[chars] * powers(_BASE, len(chars)), out=sums[1:])
        hashes = (sums[end] - sums[begin]) * powers(_INVERSE, len(chars) + 1)[begin]
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        codes = self._codes(different.tolist(), joined, begin[first].tolist(), end[first].tolist())
        sizes = np.array([len(code) // 4 for code in codes], np.int64)
        flat = np.frombuffer(b"".join(codes), "<u4")
        count = sizes[which]
        upto = np.cumsum(count)
        origin = (np.cumsum(sizes) - sizes)[which] - (upto - count)
        ids = flat[np.repeat(origin, count) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.cumsum([len(text) + 1 for text in lowered])[:-1]
        words = np.searchsorted(begin, ends)
        return np.split(ids, np.r_[0, upto][words])

    def _codes(self, hashes: list[int], text: str, begin: list[int], end: list[int]) -> list[bytes]:
        """Ids of different words, as bytes; new ones are encoded together."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        codes = list(map(known.get, hashes))
        new = [i for i, code in enumerate(codes) if code is None]
        encoded = self.words.encode_batch_fast([text[begin[i] : end[i]] for i in new], add_special_tokens=False)
        for i, code in zip(new, encoded, strict=True):
            codes[i] = known[hashes[i]] = struct.pack(f"<{len(code)}I", *code.ids)
        return codes

    def _sure(self, text: str) -> bool:
        if any(mark in text for mark in self._MARKS):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._FAR.search(text) is None
        return True

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the file's own rules give them."""
        sure = [self.by_word and self._sure(text) for text in texts]
        known = iter(self._by_word([text for text, s in zip(texts, sure, strict=True) if s]))
        return [next(known) if s else self._whole(text) for text, s in zip(texts, sure, strict=True)]


def _cut(text: str, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words: letters, one number, or other characters.

    An apostrophe that stands alone before letters takes one of the known endings with it.
    """
    kind = _KIND[chars]
    turn = np.empty(len(kind) + 1, bool)
    turn[0] = turn[-1] = True
    turn[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    quotes = np.flatnonzero(chars == ord("'"))
    for at in quotes[turn[quotes] & turn[quotes + 1]].tolist():
        if text.startswith(_ENDINGS, at + 1):
            ending = next(e for e in _ENDINGS if text.startswith(e, at + 1))
            turn[at + 1] = False
            turn[at + 1 + len(ending)] = True
    cuts = np.flatnonzero(turn)
    begin, end = cuts[:-1], cuts[1:]
    words = kind[begin] != _SPACE
    return begin[words], end[words]


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _together(texts: list[str]) -> Iterator[list[str]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > TOGETHER:
            yield texts[start:at]
            start, size = at, 0
        size += len(text)
    if texts:
        yield texts[start:]


def _tokenised(path: str, end_id: int, length: int):
    @F.arrow_udf(_PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(path)
        for column in batches:
            rows = []
            for texts in _together([text or "" for text in column.to_pylist()]):
                for found in tokenizer.ids(texts):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    parts = [(s, ids[s : s + length]) for s in range(0, len(ids), length)]
                    rows.append(
                        [
                            {"start": s, "length": len(p), "ids_crc32": zlib.crc32(p.tobytes()), "doc_tokens": len(ids)}
                            for s, p in parts
                        ]
                    )
            yield pa.array(rows, _ARROW)

    return pieces


class Slot(NamedTuple):
    """Ranks from ``rank`` on of a length go to sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    sequence: int
    offset: int


def patterns(histogram: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs, by shortest pack first."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pack: tuple[int, ...], room: int) -> None:
        if not room:
            full.append((count, pack))
            return
        if room not in open_packs:
            bisect.insort(rooms, room)
            open_packs[room] = []
        open_packs[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                put(left, (length,), most - length)
                break
            room = rooms[-1]
            count, pack = open_packs[room].pop()
            if count > left:
                open_packs[room].append((count - left, pack))
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            used = min(count, left)
            put(used, (*pack, length), room - length)
            left -= used
    return full + [p for packs in open_packs.values() for p in packs]


def slots(packed: list[tuple[int, tuple[int, ...]]]) -> list[Slot]:
    """Where the ranks of each length go; sequences are numbered from 0 without gaps."""
    ranked: dict[int, int] = {}
    out, sequence = [], 0
    for count, pack in packed:
        offset = 0
        for length in pack:
            rank = ranked.get(length, 0)
            out.append(Slot(length, rank, sequence, offset))
            ranked[length] = rank + count
            offset += length
        sequence += count
    return sorted(out)


def _placed(spark, found: list[Slot]):
    table = np.array(found, np.int64).reshape(-1, 4)
    shipped = spark.sparkContext.broadcast(table)
    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.arrow_udf(place)
    def placed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = shipped.value
        # One order over lengths and ranks: ranks stay below 2 ** 48.
        keys = (known[:, 0] << 48) + known[:, 1]
        for length, rank in batches:
            ranks = rank.to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length.to_numpy(zero_copy_only=False) << 48) + ranks, side="right") - 1
            sequence = known[at, 2] + ranks - known[at, 1]
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(known[at, 3])], ["sequence_id", "offset"])

    return placed


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Pieces with their rank among those of their length, from 0, without gaps."""
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    counts = keep(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1)
    return checked_join(numbered, keep(bases), ["length", "salt"], "inner", 32).withColumn(
        "rank", F.col("base") + F.col("own")
    )


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length >= 1 << 15:
        raise ValueError("a sequence has less than 32768 tokens")
    cut = _tokenised(vocabulary, end_id, length)
    pieces = keep(docs.select("doc_id", F.inline(cut(F.col("text")))))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = slots(patterns(histogram, length))
    salts = max(LEAST_SALTS, sum(histogram.values()) // RANKED)
    placed = _placed(docs.sparkSession, found)
    return (
        _ranked(pieces, salts)
        .withColumn("at", placed(F.col("length"), F.col("rank")))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
    )
