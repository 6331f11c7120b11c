"""Benchmark decontamination with an FM-index of every shard of training text.

The benchmark's windows (ten consecutive words of an item, or all of a shorter one) are the
query set. They go to the tasks in blocks of bounded size. A task cuts its rows into shards
of some MB, numbers the words of each shard, builds an FM-index of them (words that no
window holds share one number, and a run of them takes one place, as no window can touch
it), searches all windows of the block backwards, locates their occurrences by sampled
suffix positions, checks the words themselves, and merges the spans to remove. Rows don't
move: the result is a column beside each text.

Defined cases: a null or empty text, or one without words, has no hits. An item without
words has no windows; equal windows of several items count for each of them; repeated items
count once. Very long texts make a shard of their own. Repeated rows are judged one by one.
Other columns are kept, whatever their names. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.fm_index import FmIndex
from fleetgauge.llm.shared import LOWER_BYTES, powers

WINDOW = 10
#: Bytes of texts that share one index.
SHARD_BYTES = 2 << 20
#: Bytes of items that are searched in one pass over the documents.
BLOCK_BYTES = 16 << 20

_IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("words", pa.list_(pa.list_(pa.int64()))),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]
)


class Words:
    """The words of many texts: where each begins and ends, its 64-bit hash, and its text."""

    def __init__(self, texts: list[bytes]):
        self.lowered = b"\0".join(t.translate(LOWER_BYTES) for t in texts) + b"\0"
        data = np.frombuffer(self.lowered, np.uint8)
        inside = _IN_WORD[data]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            turns = np.r_[0, turns]
        self.begin, self.end = turns[::2], turns[1::2]
        # Differences of running sums of value * base ** place, shifted back to place 0.
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=sums[1:])
        back = powers(_INVERSE, len(data))
        self.hash = (sums[self.end] - sums[self.begin]) * back[self.begin]
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.offset = np.cumsum(lengths) - lengths
        #: Number of the first word of each text, and of the word after all.
        self.first = np.r_[np.searchsorted(self.begin, self.offset), len(self.begin)]

    def word(self, number: int) -> bytes:
        return self.lowered[self.begin[number] : self.end[number]]


class Windows:
    """A block of the benchmark: its words, numbered from 2, and its different windows."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        known = list(dict.fromkeys((str(i), t or "") for i, t in items))
        words = Words([text.encode() for _, text in known])
        self.hashes, index, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.words = [words.word(i) for i in index]
        number = number.reshape(-1) + 2
        owners: dict[tuple[int, ...], set[str]] = {}
        for row, (item, _) in enumerate(known):
            own = number[words.first[row] : words.first[row + 1]]
            for start in range(max(1, len(own) - window + 1) if len(own) else 0):
                owners.setdefault(tuple(own[start : start + window].tolist()), set()).add(item)
        self.phrases = [np.array(p, np.int64) for p in owners]
        self.owners = [sorted(o) for o in owners.values()]

    @property
    def sigma(self) -> int:
        return len(self.hashes) + 2

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number; 1 if no window holds it."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 2, 1)


def _occurrences(windows: Windows, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, number of the window) of all occurrences in a shard."""
    none = np.empty(0, np.int64)
    if not windows.phrases or not len(words.hash):
        return none, none
    number = windows.numbers(words.hash)
    count = len(number)
    ends = words.first[1:]
    # The words with an end mark after each text, and a run of unknown words as one.
    symbols = np.insert(number, ends, 0)
    source = np.insert(np.arange(count), ends, -1)
    keep = np.r_[True, (symbols[1:] != 1) | (symbols[:-1] != 1)]
    symbols, source = symbols[keep], source[keep]
    index = FmIndex(symbols, windows.sigma)
    low, high = index.search(windows.phrases)
    found = np.flatnonzero(low < high)
    sizes = (high - low)[found]
    which = np.repeat(found, sizes)
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[found], sizes)
    start = source[index.locate(rows)]
    # Numbers stand for hashes: the words themselves decide.
    length = np.array([len(p) for p in windows.phrases])[which]
    right: dict[int, bool] = {}

    def same(word: int) -> bool:
        if word not in right:
            right[word] = words.word(word) == windows.words[number[word] - 2]
        return right[word]

    sure = [all(same(w) for w in range(s, s + n)) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
    return start[sure], which[sure]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    spans: list[list[int]] = []
    for start, end in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return spans


def search_shard(windows: Windows, texts: list[bytes], before: list[dict | None]) -> list[dict]:
    """Hits of one block in the texts of one shard, joined to those of earlier blocks."""
    words = Words(texts)
    starts, which = _occurrences(windows, words)
    length = np.array([len(p) for p in windows.phrases], np.int64)[which]
    order = np.argsort(starts, kind="stable")
    starts, which, length = starts[order], which[order], length[order]
    cut = np.searchsorted(starts, words.first)
    out = []
    for row, text in enumerate(texts):
        first = words.first[row]
        mine = slice(cut[row], cut[row + 1])
        old = before[row] or {"items": [], "words": []}
        items, spans = old["items"], old["words"]
        if cut[row] < cut[row + 1]:
            items = sorted({*items, *(o for w in np.unique(which[mine]).tolist() for o in windows.owners[w])})
            here = starts[mine] - first
            spans = _merged(
                np.r_[here, [s for s, _ in spans]].astype(np.int64),
                np.r_[here + length[mine], [e for _, e in spans]].astype(np.int64),
            )
        places = []
        for start, end in spans:
            low = int(words.begin[first + start] - words.offset[row])
            high = int(words.end[first + end - 1] - words.offset[row])
            head = len(text[:low].decode())
            places.append([head, head + len(text[low:high].decode())])
        out.append(
            {
                "n_words": int(words.first[row + 1] - first),
                "n_hit": sum(e - s for s, e in spans),
                "items": items,
                "words": spans,
                "spans": places,
            }
        )
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``most`` bytes, one block at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if block and size + len(row["t"] or "") > most:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"] or "")
    yield block


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    into: str = "hits",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with a column ``into``: n_words, n_hit, items, and merged spans.

    ``words`` are spans of word numbers, ``spans`` of code points; ends are exclusive.
    """
    context = docs.sparkSession.sparkContext
    hits: Column = F.lit(None).cast(HITS)
    out = docs
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        windows = context.broadcast(Windows(block, window))
        out = out.withColumn(into, _searcher(windows, shard_bytes)(F.col(text), hits))
        hits = F.col(into)
    return out


def _searcher(windows, shard_bytes: int):
    @F.arrow_udf(HITS)
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, earlier in batches:
            texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
            before = earlier.to_pylist() if earlier.null_count < len(earlier) else [None] * len(texts)
            found: list[dict] = []
            start = size = 0
            for at, data in enumerate(texts):
                if at > start and size + len(data) > shard_bytes:
                    found += search_shard(windows.value, texts[start:at], before[start:at])
                    start, size = at, 0
                size += len(data)
            if texts:
                found += search_shard(windows.value, texts[start:], before[start:])
            yield pa.array(found, _ARROW)

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; columns as they were."""
    judged = with_hits(docs, benchmark, into="__hits")
    return judged.filter("__hits.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without its removal spans."""
    if text is None or not spans:
        return text
    kept = [0, *(p for span in spans for p in span), len(text)]
    return "".join(text[a:b] for a, b in zip(kept[::2], kept[1::2], strict=True))
