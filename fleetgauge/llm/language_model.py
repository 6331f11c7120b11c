"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z lower-cased, cut at ASCII white space) and an end after each text. All
training tokens are counted. The most frequent tokens are put into classes by their rank, all
others into one tail class. A token's probability is its class's, by a softmax over classes,
times its own within the class: by a softmax over the class's members, or in the tail by its
smoothed share of the tail's counts. Both softmaxes add up weights of hashed features of the
tokens before: the last one, the last two, the one but last (a skip), and the last with the
third last (a skip), and begin at the logarithms of the counts.

Training passes over all training texts once, in rounds over disjoint parts. In a round every
task makes gradient steps from the same weights on its texts, in sparse numpy batches, and
the changes are summed block by block in a shuffle, weighted by tokens, and added. Weights
have a fixed size, whatever the data, and are broadcast.

Scoring reads every text once. Counts of frequent words are broadcast (their number is
bounded by a threshold on the counts); those of all other words are joined.

Defined cases: a null or empty text has the end alone. Without training texts all counts are 0
and the classes are empty: every token is an unknown one of the tail. Repeated rows are scored
one by one. Very long texts are whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.shared import LOWER_BYTES, keep, powers

CLASSES = 16
MEMBERS = 32
#: Rows of the hashed weights of classes and of members.
CLASS_ROWS = 1 << 12
MEMBER_ROWS = 1 << 13
FEATURES = 4
ROUNDS = 3
BATCH = 16_384
RATE = 0.3
#: Weight against features with few tokens in a batch.
PRIOR = 20.0

#: Most words whose counts are broadcast.
FREQUENT = 1 << 17
#: Bits of a hash by which it is looked up.
PREFIX = 18
#: Bytes of training text for each gradient task.
TASK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
#: Parts of the weights that are summed apart.
BLOCKS = 16

SMOOTHING = 0.1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(37).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.random.default_rng(41).integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)
#: Hashes of the end, and of what stands before a text.
END, BEFORE = np.uint64(1), np.uint64(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Tokens:
    """Words of many texts, one after another, each text followed by an end."""

    def __init__(self, texts: list[bytes]):
        self.joined = b" ".join(t.translate(LOWER_BYTES) for t in texts) + b" "
        data = np.frombuffer(self.joined, np.uint8)
        space = _SPACE[data]
        turns = np.flatnonzero(np.r_[True, space[:-1]] != space)
        # A text's first byte follows a space, and the last byte of all is one.
        self.begin, self.end = turns[::2], turns[1::2]
        if len(turns) % 2:
            raise AssertionError("an unfinished word")
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=sums[1:])
        self.word = _mixed((sums[self.end] - sums[self.begin]) * powers(_INVERSE, len(data))[self.begin])
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        #: Number of each text's first word, and of the word after all.
        self.first = np.r_[np.searchsorted(self.begin, starts), len(self.begin)]
        self.rows = len(texts)

    def text(self, number: int) -> str:
        return self.joined[self.begin[number] : self.end[number]].decode()

    def with_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every token, the row it is in)."""
        hashes = np.insert(self.word, self.first[1:], END)
        rows = np.repeat(np.arange(self.rows), np.diff(self.first) + 1)
        return hashes, rows


def _shards(texts: list[bytes]) -> Iterator[list[bytes]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > SHARD_BYTES:
            yield texts[start:at]
            start, size = at, 0
        size += len(text)
    if texts:
        yield texts[start:]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of each shard."""
    for batch in batches:
        for texts in _shards(_texts(batch.column(0))):
            tokens = Tokens(texts)
            order = np.argsort(tokens.word)
            ranked = tokens.word[order]
            heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(order) else order
            count = np.diff(np.r_[heads, len(order)])
            words = [tokens.text(i) for i in order[heads].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(count, pa.int64())], ["word", "n"])


class Vocabulary(NamedTuple):
    """Sorted hashes of frequent words (the end with them), their counts, and their softmax numbers or -1."""

    hashes: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    #: Where the hashes with each value of the first ``PREFIX`` bits begin, and their end.
    begin: np.ndarray
    tokens: int
    types: int
    tail_tokens: int
    tail_types: int

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent ones, or -1."""
        prefix = (hashes >> np.uint64(64 - PREFIX)).astype(np.int64)
        place, end = self.begin[prefix], self.begin[prefix + 1]
        found = np.full(len(hashes), -1, np.int64)
        todo = np.flatnonzero(place < end)
        place, end, wanted = place[todo], end[todo], hashes[todo]
        while len(todo):
            hit = self.hashes[place] == wanted
            found[todo[hit]] = place[hit]
            more = ~hit & (place + 1 < end)
            todo, place, end, wanted = todo[more], place[more] + 1, end[more], wanted[more]
        return found


class Weights(NamedTuple):
    classes: np.ndarray
    members: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray


def vocabulary(words: list[str], counts: list[int], docs: int, tokens: int, types: int) -> Vocabulary:
    """From the frequent words and their counts; ``tokens`` and ``types`` are of all words, without ends."""
    hashes = _word_hashes(words) if words else np.empty(0, np.uint64)
    hashes = np.r_[hashes, END]
    counts = np.r_[np.array(counts, np.int64), np.int64(docs)]
    names = [*words, ""]
    order = np.array(sorted(range(len(names)), key=lambda i: (-counts[i], names[i])), np.int64)
    top = order[: CLASSES * MEMBERS]
    top = top[counts[top] > 0]
    numbers = np.full(len(names), -1, np.int64)
    numbers[top] = np.arange(len(top))
    tokens, types = tokens + docs, types + (docs > 0)
    by_hash = np.argsort(hashes)
    hashes = hashes[by_hash]
    starts = np.arange(1 << PREFIX, dtype=np.uint64) << np.uint64(64 - PREFIX)
    return Vocabulary(
        hashes,
        counts[by_hash],
        numbers[by_hash],
        np.r_[np.searchsorted(hashes, starts), len(hashes)],
        tokens,
        types,
        tokens - int(counts[top].sum()),
        types - len(top),
    )


def _word_hashes(words: list[str]) -> np.ndarray:
    tokens = Tokens([w.encode() for w in words])
    if len(tokens.word) != len(words):
        raise AssertionError("a word holds white space")
    return tokens.word


def begin_weights(known: Vocabulary) -> Weights:
    """Weights that give every token its share of the counts."""
    member = np.full((CLASSES, MEMBERS), -1e9, np.float32)
    mass = np.zeros(CLASSES + 1)
    mass[CLASSES] = known.tail_tokens + SMOOTHING * (known.tail_types + 1)
    some = known.numbers >= 0
    number, count = known.numbers[some], known.counts[some]
    member[number // MEMBERS, number % MEMBERS] = np.log(count)
    np.add.at(mass, number // MEMBERS, count)
    class_bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-300)), -1e9).astype(np.float32)
    return Weights(
        np.zeros((CLASS_ROWS, CLASSES + 1), np.float32),
        np.zeros((MEMBER_ROWS, MEMBERS), np.float32),
        class_bias - class_bias.max(),
        member,
    )


class Batch(NamedTuple):
    """Tokens of a shard: class and member numbers, and hashed features of the tokens before."""

    cls: np.ndarray
    member: np.ndarray
    features: np.ndarray
    place: np.ndarray


def batch_of(hashes: np.ndarray, rows: np.ndarray, known: Vocabulary) -> Batch:
    place = known.lookup(hashes)
    number = np.where(place >= 0, known.numbers[place], -1)
    cls = np.where(number >= 0, number // MEMBERS, CLASSES)
    before = []
    for back in (1, 2, 3):
        earlier = np.full(len(hashes), BEFORE, np.uint64)
        same = rows[back:] == rows[:-back]
        earlier[back:][same] = hashes[:-back][same]
        before.append(earlier)
    one, two, three = before
    features = np.stack(
        [
            _mixed(one * _MIX[0]),
            _mixed(one * _MIX[1] + two * _MIX[2]),
            _mixed(two * _MIX[3] + np.uint64(3)),
            _mixed(one * _MIX[4] + three * _MIX[5] + np.uint64(4)),
        ]
    )
    return Batch(cls, np.where(number >= 0, number % MEMBERS, 0), features, place)


def _class_rows(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(40) & np.uint64(CLASS_ROWS - 1)).astype(np.uint16)


def _member_rows(features: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return (_mixed(features + cls.astype(np.uint64) * _MIX[6]) >> np.uint64(40) & np.uint64(MEMBER_ROWS - 1)).astype(np.uint16)


def _logits(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of each token's rows, at most 0, and the logarithms of the sums of their exponentials."""
    logits = table.take(rows[0], axis=0)
    logits += bias
    term = np.empty_like(logits)
    for more in rows[1:]:
        logits += table.take(more, axis=0, out=term, mode="clip")
    logits -= logits.max(axis=1, keepdims=True)
    return logits, np.log(np.exp(logits, out=term).sum(axis=1, keepdims=True))


def _log_odds(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of the summed weights of each token's rows, at the number in ``right``."""
    logits, sums = _logits(table, rows, bias)
    return logits[np.arange(len(right)), right] - sums[:, 0]


def _step(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, right: np.ndarray) -> None:
    """One gradient step of a softmax: each row by the mean error of its tokens."""
    wrong, sums = _logits(table, rows, bias)
    wrong -= sums
    np.negative(np.exp(wrong, out=wrong), out=wrong)
    wrong[np.arange(len(right)), right] += 1
    dealt = np.empty_like(wrong)
    for feature in rows:
        order = np.argsort(feature, kind="stable")
        ranked = feature[order]
        heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        count = np.diff(np.r_[heads, len(ranked)]).astype(np.float32)[:, None]
        step = np.add.reduceat(wrong.take(order, axis=0, out=dealt, mode="clip"), heads)
        table[ranked[heads]] += RATE * step / (count + PRIOR)


def learn(weights: Weights, batch: Batch) -> None:
    """Gradient steps on the tokens of a shard, batch by batch; changes the hashed weights."""
    for start in range(0, len(batch.cls), BATCH):
        part = slice(start, start + BATCH)
        cls, features = batch.cls[part], batch.features[:, part]
        _step(weights.classes, _class_rows(features), weights.class_bias, cls)
        inside = np.flatnonzero(cls < CLASSES)
        if len(inside):
            own, mine = cls[inside], features[:, inside]
            _step(weights.members, _member_rows(mine, own), weights.member_bias[own], batch.member[part][inside])


def log10_model(weights: Weights, batch: Batch) -> np.ndarray:
    """Each token's log10 of its class's probability, times its own in the class if that isn't the tail."""
    out = np.empty(len(batch.cls))
    for start in range(0, len(batch.cls), BATCH):
        part = slice(start, start + BATCH)
        cls, features = batch.cls[part], batch.features[:, part]
        got = _log_odds(weights.classes, _class_rows(features), weights.class_bias, cls).astype(np.float64)
        inside = np.flatnonzero(cls < CLASSES)
        if len(inside):
            own, mine = cls[inside], features[:, inside]
            right = batch.member[part][inside]
            got[inside] += _log_odds(weights.members, _member_rows(mine, own), weights.member_bias[own], right)
        out[part] = got
    return out / np.log(10)


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights.classes.reshape(-1), weights.members.reshape(-1)])


def _moved(weights: Weights, change: np.ndarray) -> Weights:
    cut = weights.classes.size
    return weights._replace(
        classes=weights.classes + change[:cut].reshape(weights.classes.shape),
        members=weights.members + change[cut:].reshape(weights.members.shape),
    )


def _round(texts: DataFrame, weights: Weights, known) -> Weights:
    """All texts' gradient steps from the same weights, the tasks' changes averaged by tokens."""
    context = texts.sparkSession.sparkContext
    shipped = context.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = shipped.value
        own = begin._replace(classes=begin.classes.copy(), members=begin.members.copy())
        seen = 0
        for batch in batches:
            for part in _shards(_texts(batch.column(0))):
                hashes, rows = Tokens(part).with_ends()
                learn(own, batch_of(hashes, rows, known.value))
                seen += len(hashes)
        if seen:
            change = np.array_split((_flat(own) - _flat(begin)) * np.float32(seen), BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS), pa.array([c.tobytes() for c in change])],
                ["block", "tokens", "change"],
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, tokens, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(block, [0, 0.0])
                held[0] += tokens
                held[1] = held[1] + np.frombuffer(change, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int32()),
                    pa.array([h[0] for h in sums.values()]),
                    pa.array([h[1].astype(np.float32).tobytes() for h in sums.values()]),
                ],
                ["block", "tokens", "change"],
            )

    schema = "block int, tokens long, change binary"
    changed = texts.mapInArrow(task, schema).repartition("block").mapInArrow(total, schema).collect()
    if not changed:
        return weights
    parts = sorted((r["block"], np.frombuffer(r["change"], np.float32) / r["tokens"]) for r in changed)
    return _moved(weights, np.concatenate([p for _, p in parts]))


class Model(NamedTuple):
    known: Vocabulary
    weights: Weights
    #: Kept table (word, n) of all training words.
    counts: DataFrame
    frequent_from: int


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of a frame with one column of texts."""
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int) -> int:
    """Least count such that at most ``most`` words have it or more, by bins of counts."""
    bins = (
        counts.groupBy(F.floor(8 * F.log2("n")).alias("bin"))
        .agg(F.count("*").alias("words"), F.min("n").alias("low"))
        .orderBy(F.desc("bin"))
        .collect()
    )
    total, least = 0, None
    for row in bins:
        total += row["words"]
        if total > most:
            break
        least = row["low"]
    return least if least is not None else (max(r["low"] for r in bins) * 2 if bins else 1)


def fit(docs: DataFrame, learned: Column, *, frequent: int = FREQUENT, rounds: int = ROUNDS) -> Model:
    """A model of the rows of ``docs`` (doc_id, text) that ``learned`` takes."""
    training = docs.filter(learned)
    texts = training.select("text")
    size = training.agg(
        F.count("*").alias("docs"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes")
    ).first()
    counts = keep(count_words(texts))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    least = _threshold(counts, frequent)
    top = counts.filter(F.col("n") >= least).toArrow()
    known = vocabulary(
        top["word"].to_pylist(), top["n"].to_pylist(), size["docs"], int(whole["tokens"]), int(whole["types"])
    )
    weights = begin_weights(known)
    shipped = docs.sparkSession.sparkContext.broadcast(known)
    tasks = max(1, int(size["bytes"] or 0) // TASK_BYTES)
    for turn in range(rounds):
        part = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).select("text")
        weights = _round(part.coalesce(tasks), weights, shipped)
    return Model(known, weights, counts, least)


_SCORED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("model", T.DoubleType()),
        T.StructField("n_tail", T.LongType()),
        T.StructField("tail", T.DoubleType()),
        T.StructField(
            "rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.LongType())]))
        ),
    ]
)


def _scorer(model: Model, context):
    known, weights = context.broadcast(model.known), context.broadcast(model.weights)

    @F.arrow_udf(_SCORED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("word", pa.string()), ("times", pa.int64())])
        vocabulary = known.value
        frequent = np.log10(vocabulary.counts + SMOOTHING)
        for column in batches:
            columns: list[list] = [[] for _ in range(6)]
            offsets, words, times = [0], [], []
            for texts in _shards(_texts(column)):
                tokens = Tokens(texts)
                hashes, rows = tokens.with_ends()
                batch = batch_of(hashes, rows, vocabulary)
                inside = batch.place >= 0
                tail = batch.cls == CLASSES
                value = np.where(inside, frequent[batch.place], 0.0)

                def total(values: np.ndarray, rows=rows, count=len(texts)) -> np.ndarray:
                    return np.bincount(rows, values, count)

                columns[0].append(total(np.ones(len(rows))))
                columns[1].append(total(inside & (vocabulary.counts[batch.place] > 0)))
                columns[2].append(total(value))
                columns[3].append(total(log10_model(weights.value, batch)))
                columns[4].append(total(tail))
                columns[5].append(total(np.where(tail, value, 0.0)))
                # The end is a frequent token, and a row has one end for each row before it.
                missing = np.flatnonzero(~inside)
                row = rows[missing]
                number = missing - row
                pairs = np.lexsort((tokens.word[number], row))
                number, row = number[pairs], row[pairs]
                new = np.r_[True, (row[1:] != row[:-1]) | (tokens.word[number[1:]] != tokens.word[number[:-1]])]
                heads = np.flatnonzero(new) if len(number) else np.empty(0, np.int64)
                words += [tokens.text(i) for i in number[heads].tolist()]
                times.append(np.diff(np.r_[heads, len(number)]))
                per_row = np.bincount(row[heads], minlength=len(texts))
                offsets.extend((offsets[-1] + np.cumsum(per_row)).tolist())
            arrays = [np.concatenate(c) if c else np.empty(0) for c in columns]
            rare = pa.StructArray.from_arrays(
                [pa.array(words, pa.string()), pa.array(np.concatenate(times) if times else np.empty(0, np.int64), pa.int64())],
                fields=list(kind),
            )
            yield pa.StructArray.from_arrays(
                [
                    *(pa.array(arrays[i].astype(np.int64)) if i in (0, 1, 4) else pa.array(arrays[i]) for i in range(6)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare),
                ],
                _SCORED.names,
            )

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score, score."""
    context = docs.sparkSession.sparkContext
    rows = keep(
        docs.select("doc_id", _scorer(model, context)(F.col("text")).alias("s"))
        .select("doc_id", "s.*")
        .withColumn("row", F.monotonically_increasing_id())
    )
    least = F.lit(SMOOTHING)
    rare = (
        rows.select("row", F.inline("rare"))
        .join(model.counts.filter(F.col("n") < model.frequent_from).hint("shuffle_merge"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + least)).alias("rare_sum"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    known = model.known
    per_token = float(np.log10(known.tokens + SMOOTHING * (known.types + 1)))
    per_tail = float(np.log10(known.tail_tokens + SMOOTHING * (known.tail_types + 1)))
    more = F.coalesce("rare_sum", F.lit(0.0))
    return rows.drop("rare").join(rare.hint("shuffle_merge"), "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("model") + F.col("tail") + more - F.col("n_tail") * F.lit(per_tail)).alias("score"),
    )
