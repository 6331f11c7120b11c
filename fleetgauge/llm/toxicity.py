"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at its borders) and itself, all hashed
into one table of embeddings; its vector is their mean, a text's vector the mean over its
words, and a softmax over the two classes reads it. Table and softmax are trained together by
minibatch gradient steps on a bounded sample of the labelled rows. Misspellings that never
occurred share most n-grams with the words they come from.

As the softmax is linear, a word's share in the score is one number per table row; this table
of numbers is broadcast (its size is a parameter, whatever the data), and every whole text is
scored where it lies. New words of a batch are scored together, once.

Defined cases: a null or empty text, or one without words, has the score of an empty bag (the
softmax's bias). Repeated rows are scored one by one. Very long texts count whole. Other
columns are kept by ``with_score``. Labelled texts of over ``TEXT_BYTES`` are not learned, but
scored. Without labelled rows of both classes, all scores are 0; if there are such rows and the
sample has none of one class, that is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fleetgauge.llm.shared import powers

BUCKETS = 1 << 17
WIDTH = 4
GRAMS = (3, 5)
#: Passes over the sample, and minibatch steps at least: a small sample is passed more often.
EPOCHS = 5
STEPS = 400
BATCH = 128
RATE = 2.0
#: Texts a table row must be seen in to be learned, and the weight against rare rows.
LEAST_SEEN = 5
NEUTRAL = 20
PRIOR = 2

#: Bounds of the sample that the model is fitted to: rows, and bytes of their texts.
SAMPLE_ROWS = 12_288
SAMPLE_BYTES = 24 << 20
#: Bytes beyond which a labelled text is left out of the sample.
TEXT_BYTES = 1 << 20

THRESHOLD = 0.7

#: Most words whose numbers a task remembers.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shares(count: np.ndarray) -> np.ndarray:
    """Shares of different words in their text's mean, by how often they occur.

    A repeated word counts less than as many different ones, and ``NEUTRAL`` words without
    content are added, so that a text of one or few words isn't judged by them alone.
    """
    weight = 1 + np.log(count)
    return (weight / (weight.sum() + NEUTRAL)).astype(np.float32)


def buckets_of(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of all words' n-grams, one after another; where each word's begin)."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint64(1)) * powers(_BASE, len(chars)), out=sums[1:])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(begin + sizes, sizes) - np.arange(len(chars))
    places, ends = [begin], [begin + sizes]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        # A gram as long as its marked word would only repeat the word itself.
        at = at[sizes[owner[at]] > n]
        places.append(at)
        ends.append(at + n)
        owners.append(owner[at])
    place, end, whose = (np.concatenate(x) for x in (places, ends, owners))
    order = np.argsort(whose, kind="stable")
    place, end, whose = place[order], end[order], whose[order]
    hashed = (sums[end] - sums[place]) * powers(_INVERSE, len(chars) + 1)[place]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    rows = (hashed >> np.uint64(40)).astype(np.int64) % buckets
    return rows, np.searchsorted(whose, np.arange(len(words)))


class Model:
    """What a trained model says about words: ``share`` per table row, and the bias."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share.astype(np.float32), float(bias)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number: the difference of the classes' logits it adds to a mean."""
        if not words:
            return np.empty(0)
        rows, begin = buckets_of(words, len(self.share))
        count = np.diff(np.r_[begin, len(rows)])
        return np.add.reduceat(self.share[rows].astype(np.float64), begin) / count


def _rows_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of all words' grams, number of each word's), some words at a time."""
    rows, sizes = [], []
    for start in range(0, len(words), 20_000):
        some, begin = buckets_of(words[start : start + 20_000], buckets)
        rows.append(some.astype(np.int32))
        sizes.append(np.diff(np.r_[begin, len(some)]))
    return (np.concatenate(rows), np.concatenate(sizes)) if rows else (np.empty(0, np.int32), np.empty(0, np.int64))


def _gathered(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin .. begin + count of every entry, one entry after another."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1])


def _scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``values`` per row number."""
    return np.stack([np.bincount(rows, column, size) for column in values.T], axis=1).astype(np.float32)


def train(
    texts: list[str], toxic: list[int], *, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, seed: int = 5
) -> Model:
    """Embeddings and softmax fitted to labelled texts by minibatch steps with Adagrad.

    Table rows seen in fewer than ``LEAST_SEEN`` texts stay 0, and the steps of rare rows are
    shortened, so that no text is told by its own rare words.
    """
    labels = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(buckets), -np.inf)
    random = np.random.default_rng(seed)
    # Both classes weigh the same, whatever their shares.
    weight = (len(labels) / 2 / np.bincount(labels, minlength=2)).astype(np.float32)
    vocabulary: dict[str, int] = {}
    bags = []
    for text in texts:
        found = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64)
        own, count = np.unique(found, return_counts=True)
        bags.append((own.astype(np.int32), shares(count)))
    del texts
    rows, size = _rows_of(list(vocabulary), buckets)
    begin = np.cumsum(size) - size
    seen = np.zeros(buckets)
    for own, _ in bags:
        if len(own):
            seen[np.unique(rows[_gathered(begin[own], size[own])])] += 1
    # Words keep the grams that are learned; the mean still counts all of them.
    learned = (seen >= LEAST_SEEN)[rows]
    kept = np.add.reduceat(learned.astype(np.int64), begin)
    rows = rows[learned]
    at = np.cumsum(kept) - kept
    reach = (seen / (seen + PRIOR)).astype(np.float32)[:, None] * (seen >= LEAST_SEEN)[:, None]
    table = random.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32) * reach
    softmax = random.uniform(-1, 1, (width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full((buckets, 1), 1e-8, np.float32), np.full_like(softmax, 1e-6), np.full_like(bias, 1e-6)]
    filled = [i for i, (own, _) in enumerate(bags) if len(own)]
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(filled))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = random.permutation(filled)
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            # Words of the batch, numbered within it, and their shares in each document.
            share = np.concatenate([bags[i][1] for i in chosen])
            first = np.cumsum([0, *(len(bags[i][0]) for i in chosen)])
            document = np.repeat(np.arange(len(chosen)), np.diff(first))
            used, word = np.unique(np.concatenate([bags[i][0] for i in chosen]), return_inverse=True)
            owner = np.repeat(np.arange(len(used)), kept[used])
            gram = rows[_gathered(at[used], kept[used])]
            scale = (1 / size[used]).astype(np.float32)[:, None]
            vectors = np.zeros((len(used), width), np.float32)
            some = kept[used] > 0
            vectors[some] = np.add.reduceat(table[gram], (np.cumsum(kept[used]) - kept[used])[some])
            vectors *= scale
            means = np.add.reduceat(vectors[word] * share[:, None], first[:-1])
            logits = means @ softmax + bias
            logits -= logits.max(1, keepdims=True)
            odds = np.exp(logits)
            wrong = odds / odds.sum(1, keepdims=True)
            wrong[np.arange(len(chosen)), labels[chosen]] -= 1
            wrong *= (weight[labels[chosen]] / len(chosen))[:, None]
            to_mean = wrong @ softmax.T
            to_vector = _scattered(word, to_mean[document] * share[:, None], len(used)) * scale
            step = _scattered(gram, to_vector[owner], buckets)
            squares[0] += (step**2).mean(1, keepdims=True)
            table -= rate * reach * step / np.sqrt(squares[0])
            for value, change, total in ((softmax, means.T @ wrong, squares[1]), (bias, wrong.sum(0), squares[2])):
                total += change**2
                value -= rate * change / np.sqrt(total)
    return Model(table @ (softmax[:, 1] - softmax[:, 0]), bias[1] - bias[0])


def _labelled(labels: DataFrame, chosen: Column) -> DataFrame:
    """(doc_id, toxic): the label of each id that ``chosen`` takes."""
    found = labels.filter(chosen & F.col("toxic").isin(0, 1))
    return found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, chosen: Column, rows: int, most_bytes: int) -> DataFrame:
    """At most ``rows`` labelled rows with at most ``most_bytes`` of text, by the hash of their ids.

    A text of over ``TEXT_BYTES`` is left out and takes no room from the others.
    """
    order = F.xxhash64("doc_id")
    ids = _labelled(labels, chosen).orderBy(order, "doc_id").limit(rows)
    upto = Window.orderBy(order, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return (
        docs.select("doc_id", "text")
        .filter(size <= TEXT_BYTES)
        .join(F.broadcast(ids), "doc_id")
        .orderBy(order, "doc_id", "text")
        .limit(rows)
        .withColumn("bytes", F.sum(size).over(upto))
        .filter(F.col("bytes") <= most_bytes)
        .select("text", "toxic")
    )


def fit(
    docs: DataFrame, labels: DataFrame, chosen: Column, *, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> Model:
    """A model of the labelled rows that ``chosen`` (over ``labels``) takes.

    One task trains it on the bounded sample; only the model comes to the driver.
    """
    found = sample(docs, labels, chosen, rows, most_bytes).coalesce(1)
    trained = found.mapInArrow(_trained, "share binary, bias double, classes int").first()
    if trained is None or trained["classes"] < 2:
        given = docs.select("doc_id").join(_labelled(labels, chosen), "doc_id").select("toxic").distinct().count()
        if given == 2:
            raise ValueError("the sample of labelled rows lacks one of the two classes that the labels have")
    if trained is None:
        return train([], [])
    return Model(np.frombuffer(trained["share"], np.float32), trained["bias"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, toxic = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        toxic += batch.column(1).to_pylist()
    model = train(texts, toxic)
    columns = [pa.array([model.share.tobytes()]), pa.array([model.bias]), pa.array([len(set(toxic))], pa.int32())]
    yield pa.RecordBatch.from_arrays(columns, ["share", "bias", "classes"])


def with_score(docs: DataFrame, model: Model, *, into: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability that each text is toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        known: dict[str, float] = {}
        for column in batches:
            scores = []
            for first in range(0, len(column), 512):
                bags = [Counter(words_of(text)) for text in column[first : first + 512].to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list({w for bag in bags for w in bag if w not in known})
                known.update(zip(new, model.numbers(new).tolist(), strict=True))
                for bag in bags:
                    share = shares(np.fromiter(bag.values(), np.int64, len(bag)))
                    scores.append(share @ np.fromiter(map(known.__getitem__, bag), np.float64, len(bag)) + model.bias)
            yield pa.array(1 / (1 + np.exp(-np.array(scores, np.float64))))

    return docs.withColumn(into, scored(F.col(text)))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, chosen: Column, *, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more; columns as they were."""
    scored = with_score(docs, fit(docs, labels, chosen), into="__score")
    return scored.filter(F.col("__score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
