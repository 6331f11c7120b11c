"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its words (A-Z lower-cased) and its 5-word shingles, labelled by how often each
occurred before. A sketch takes the least ``PICKED`` labelled shingles under one hash function and
joins them in the order they have in the text, so that it is sensitive to moves as the edit
similarity is. Texts with ``COMMON`` equal sketches out of ``SKETCHES``, two of them neighbours
(the last one's neighbour is the first), are candidates, and a banded alignment decides: a longest
chain of common shingles that rises in both texts, within a band of diagonals, must hold at least
``SIMILARITY`` of all shingles of both (common ones counted once).

Equal word sequences are one text from the start. Two equal neighbouring sketches make buckets, and
no bucket is compared pair by pair. The text that meets most others is its bucket's pivot, and all
members are compared to it. Then connected components are taken, and buckets within one component
are done. In the others, texts with more shingles of their own than an alignment may leave out are
set aside: nothing can be similar to them. Pivots, members of small components first, are then
compared to all members that are in another component and might be similar, twice as many in each
round, until every bucket is of one component. No bucket is cut off, none is held by one task, and
no candidate is left out, whatever the size of its bucket.

Defined cases: texts without words (also null and empty ones) are alone in their classes. A
text of fewer than five words is one shingle. A class is named by its largest doc_id, and that
row stays (of repeated ids the one with the largest locator). Repeated rows are one text. Very
long texts are whole. Other columns are kept by ``drop_near_copies``, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.components import components
from fleetgauge.llm.decontaminate import Words
from fleetgauge.llm.shared import arrow_rows, checked_join, keep, located, restored

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
PICKED = 3
#: Equal sketches that make two texts candidates. A pair at the similarity has 20 * 0.8 ** 3 = 10 on average,
#: and is a candidate with a probability of 0.988; at a similarity of 0.85 with one of 0.9987.
COMMON = 4
#: Pivots of a bucket in the first round after one pivot each; later rounds take twice as many as the one before.
PIVOTS = 1024
#: 64-bit words of a parity map.
PARITY = 16
#: Texts, and pairs of texts, that a Python worker gets at once.
TEXTS_AT_ONCE = 1000
PAIRS_AT_ONCE = 200

#: Bytes of texts whose words are found together; a worker holds some 50 times as much.
SHARD_BYTES = 256 << 10

_SEEDS = np.random.default_rng(23).integers(1, 1 << 63, SKETCHES, np.uint64)
_ORDERED = np.random.default_rng(29).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)

_SKETCHED = T.StructType(
    [
        T.StructField("content", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("sketches", T.ArrayType(T.LongType())),
    ]
)
_ARROW = pa.struct([("content", pa.binary()), ("n", pa.int64()), ("sketches", pa.list_(pa.int64()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles of a sequence of word hashes."""
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    return _mixed(sum((words[i : i + count] * _ORDERED[i] for i in range(size)), np.zeros(count, np.uint64)))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value occurred before."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    place = np.arange(len(values))
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if first.all():
        return np.zeros(len(values), np.int64)
    out = np.empty(len(values), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out


def order_sketches(found: np.ndarray) -> list[int]:
    """The sketches of a text's shingles; equal only for the same sketch number."""
    ranks = _mixed(labelled(found)[None, :] ^ _SEEDS[:, None])
    if len(found) > PICKED:
        picked = np.sort(np.argpartition(ranks, PICKED - 1, axis=1)[:, :PICKED], axis=1)
    else:
        picked = np.broadcast_to(np.arange(len(found)), (SKETCHES, len(found)))
    joined = (found[picked] * _ORDERED[:PICKED][None, : picked.shape[1]]).sum(axis=1, dtype=np.uint64)
    return _mixed(joined ^ _SEEDS).view(np.int64).tolist()


def _shards(texts: list[bytes]) -> Iterator[tuple[list[bytes], Words]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > SHARD_BYTES:
            yield texts[start:at], Words(texts[start:at])
            start, size = at, 0
        size += len(text)
    if texts:
        yield texts[start:], Words(texts[start:])


@F.arrow_udf(_SKETCHED)
def _sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        out = []
        for part, words in _shards([t or b"" for t in column.cast(pa.binary()).to_pylist()]):
            for row in range(len(part)):
                own = words.hash[words.first[row] : words.first[row + 1]]
                out.append(
                    {
                        "content": hashlib.blake2b(own.tobytes(), digest_size=16).digest(),
                        "n": len(own),
                        "sketches": order_sketches(shingles(own)) if len(own) else [],
                    }
                )
        yield pa.array(out, _ARROW)


@F.arrow_udf(T.BinaryType())
def _sequence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        out = []
        for part, words in _shards([t or b"" for t in column.cast(pa.binary()).to_pylist()]):
            out += [words.hash[words.first[r] : words.first[r + 1]].tobytes() for r in range(len(part))]
        yield pa.array(out, pa.binary())


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for place, value in enumerate(values):
        at = bisect.bisect_left(tops, value)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            ends.append(place)
        else:
            tops[at], ends[at] = value, place
    found = []
    place = ends[-1] if ends else -1
    while place >= 0:
        found.append(place)
        place = before[place]
    return found[::-1]


def labelled(found: np.ndarray) -> np.ndarray:
    """Shingles made different by how often each occurred before."""
    return found + _mixed(occurrences(found).astype(np.uint64) + np.uint64(77))


def banded_alignment(one: np.ndarray, two: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles that an alignment of two labelled shingle sequences matches.

    A longest chain of equal shingles that rises in both sequences, among the matches whose
    places differ by at most ``band``.
    """
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) > 1 and not (j[1:] > j[:-1]).all():
        chain = longest_rising(j.tolist())
        i, j = i[chain], j[chain]
    return i, j


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of aligned shingles in all shingles of two word sequences; 0.0 where it is below ``least``."""
    if not len(a) or not len(b):
        return 0.0
    if np.array_equal(a, b):
        return 1.0
    words = len(a) + len(b)
    if min(len(a), len(b)) < SHINGLE or 2 * min(len(a), len(b)) < least * words:
        return 0.0
    # Words left out shift an alignment, and no more than all that may be left out.
    i, _ = banded_alignment(labelled(shingles(a)), labelled(shingles(b)), int(words * (1 - least)) + 1)
    share = len(i) / (words - 2 * (SHINGLE - 1) - len(i))
    return share if share >= least else 0.0


@F.arrow_udf(T.BooleanType())
def _alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for first, second in batches:
        yield pa.array(
            [
                similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= SIMILARITY
                for a, b in zip(first.to_pylist(), second.to_pylist(), strict=True)
            ],
            pa.bool_(),
        )


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The labelled shingles of a word sequence."""
    for column in batches:
        found = [labelled(shingles(np.frombuffer(s, np.uint64))).view(np.int64) for s in column.to_pylist()]
        yield pa.array(found, pa.list_(pa.int64()))


def parity_map(found: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of labelled shingles falls on them.

    Every shingle that only one of two texts has turns one bit, so no more bits differ than shingles do.
    """
    bits = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _parities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The parity map of a word sequence."""
    for column in batches:
        found = [parity_map(labelled(shingles(np.frombuffer(s, np.uint64)))) for s in column.to_pylist()]
        yield pa.array(found, pa.list_(pa.int64()))


def bucket_keys(sketches: Column) -> Column:
    """One key for each two neighbouring sketches."""
    return F.array(
        *[F.xxhash64(F.lit(i), sketches[i], sketches[(i + 1) % SKETCHES]) for i in range(SKETCHES)]
    )


def _size(n: str) -> Column:
    """Shingles of a text of ``n`` words."""
    return F.greatest(F.col(n) - (SHINGLE - 1), F.lit(1))


def _possible(one: str, two: str) -> Column:
    """Whether an alignment can hold enough shingles: no more than either text shares with others."""
    aligned = F.least(f"{one}.most", f"{two}.most") * (1 + SIMILARITY)
    return aligned >= SIMILARITY * (_size(f"{one}.n") + _size(f"{two}.n")) - 1e-6


def _near(one: str, two: str) -> Column:
    """Whether an alignment can hold enough shingles: at most so many are in one of the texts only."""
    unlike = sum((F.bit_count(F.col(f"{one}.parity")[i].bitwiseXOR(F.col(f"{two}.parity")[i])) for i in range(PARITY)), F.lit(0))
    return unlike * (1 + SIMILARITY) <= (1 - SIMILARITY) * (_size(f"{one}.n") + _size(f"{two}.n")) + 1e-6


def _ends(one: str, two: str) -> list[Column]:
    ids = (f"{one}.id", f"{two}.id")
    return [F.greatest(*ids).alias("u"), F.least(*ids).alias("v")]


def _equal(one: str, two: str) -> Column:
    """How many sketches of two texts are equal; unlike numbers of sketches never are."""
    return F.size(F.array_intersect(one, two))


def _first_key(one: str, two: str) -> Column:
    """Key of the first bucket that two texts share."""
    return F.element_at(F.array_intersect(bucket_keys(F.col(one)), bucket_keys(F.col(two))), 1)


class _Classes:
    """Rounds of comparison over the different texts of ``texts`` (id, n, sketches).

    ``sequences`` gives (id, sequence) for a table of ids. Members of buckets are rows of
    (key, id, n, most, component, size): ``most`` shingles of the text are in any other one.
    """

    def __init__(self, texts: DataFrame, sequences):
        self.texts = texts.filter("n > 0")
        self.fetched = sequences
        self.sequences: DataFrame | None = None
        self.named: DataFrame | None = None

    def buckets(self) -> DataFrame:
        """Texts by two neighbouring sketches, where at least two share them."""
        each = self.texts.select("id", "n", F.explode(bucket_keys(F.col("sketches"))).alias("key"))
        sizes = each.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        members = keep(
            each.join(sizes.hint("shuffle_merge"), "key").select(
                "key", "id", "n", _size("n").alias("most"), F.col("id").alias("component"), "size"
            )
        )
        # Only texts that share a bucket are looked at again.
        some = members.select("id").distinct()
        self.texts = keep(self.texts.join(some.hint("shuffle_merge"), "id", "left_semi").select("id", "sketches"))
        return members

    def open(self, members: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component."""
        named = members
        if self.named is not None:
            names = self.named.select(F.col("node").alias("id"), F.col("component").alias("name"))
            joined = members.join(names.hint("shuffle_merge"), "id", "left")
            named = joined.withColumn("component", F.coalesce("name", "id")).drop("name")
        mixed = (
            named.groupBy("key")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
            .filter("low < high")
            .select("key", "size")
        )
        return keep(named.drop("size").join(mixed.hint("shuffle_merge"), "key"))

    def hopeful(self, members: DataFrame) -> DataFrame:
        """``members`` without the texts that can't be similar to any other of them.

        A shingle that one text alone has is in no alignment of it.
        """
        ids = members.select("id").distinct()
        if self.sequences is None:
            self.sequences = keep(self.fetched(ids))
        else:
            self.sequences = keep(self.sequences.join(ids.hint("shuffle_merge"), "id", "left_semi"))
        each = self.sequences.select("id", F.explode(_shingled(F.col("sequence"))).alias("shingle"))
        alone = each.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("id").alias("id")).filter("texts = 1")
        own = alone.groupBy("id").agg(F.count("*").alias("own"))
        rest = members.join(own.hint("shuffle_merge"), "id", "left")
        most = _size("n") - F.coalesce("own", F.lit(0))
        return rest.withColumn("most", most).drop("own").filter(most >= SIMILARITY * _size("n") - 1e-6)

    def mapped(self, members: DataFrame) -> None:
        """Parity maps beside the sketches of the texts of ``members``."""
        ids = members.select("id").distinct()
        wanted = self.sequences.join(ids.hint("shuffle_merge"), "id", "left_semi")
        maps = wanted.select("id", _parities(F.col("sequence")).alias("parity"))
        self.texts = keep(self.texts.join(maps.hint("shuffle_merge"), "id"))

    def first_round(self, members: DataFrame) -> DataFrame:
        """One pivot for each bucket, the text that meets most others; members without them."""
        tie = F.xxhash64("id").alias("tie")
        degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
        ranked = members.join(degree.hint("shuffle_merge"), "id")
        best = ranked.groupBy("key").agg(F.max(F.struct("degree", tie, "id", "n", "most")).alias("p"))
        chosen = keep(best.select("key", "p.id", "p.n", "p.most"))
        met = members.alias("m").join(chosen.alias("p").hint("shuffle_merge"), "key").filter("m.id <> p.id")
        pairs = met.filter(_possible("m", "p")).select(*_ends("m", "p")).distinct()
        one = self.texts.select(F.col("id").alias("u"), F.col("sketches").alias("su"))
        two = self.texts.select(F.col("id").alias("v"), F.col("sketches").alias("sv"))
        both = pairs.join(one.hint("shuffle_merge"), "u").join(two.hint("shuffle_merge"), "v")
        self._verify(both.filter(_equal("su", "sv") >= COMMON).select("u", "v"))
        return self._without(members, chosen)

    def compare(self, members: DataFrame, pivots: int) -> DataFrame:
        """One round: the pivots against all members of other components; members without the pivots.

        Members of small components come first: a bucket is done when all but one are compared.
        Pairs with too many shingles in one text only, as their parity maps tell, are left out.
        Two texts are compared in the first bucket that they share, and there when the first of
        them is a pivot, so no pair is written twice.
        """
        alike = members.groupBy("key", "component").agg(F.count("*").alias("alike"))
        ranked = members.join(alike.hint("shuffle_merge"), ["key", "component"])
        first = F.struct((-F.col("alike")).alias("alike"), F.xxhash64("id").alias("tie"), "id")
        part = F.pmod(F.xxhash64("id"), F.lit(pivots)).alias("part")
        best = ranked.groupBy("key", part).agg(F.max(first).alias("p"))
        chosen = keep(best.select("key", "p.id"))
        flagged = members.join(
            chosen.withColumn("pivot", F.lit(True)).hint("shuffle_merge"), ["key", "id"], "left"
        ).join(self.texts.hint("shuffle_merge"), "id")
        met = flagged.alias("m").join(
            flagged.filter("pivot").alias("p").hint("shuffle_merge"),
            (F.col("m.key") == F.col("p.key"))
            & (F.col("m.component") != F.col("p.component"))
            & (F.col("m.pivot").isNull() | (F.col("m.id") < F.col("p.id")))
            & _possible("m", "p")
            & _near("m", "p")
            & (_equal("m.sketches", "p.sketches") >= COMMON)
            & (F.col("m.key") == _first_key("m.sketches", "p.sketches")),
        )
        self._verify(met.select(*_ends("m", "p")))
        return self._without(members, chosen)

    @staticmethod
    def _without(members: DataFrame, chosen: DataFrame) -> DataFrame:
        return members.join(chosen.select("key", "id").hint("shuffle_merge"), ["key", "id"], "left_anti")

    def _verify(self, pairs: DataFrame) -> None:
        """Align the candidates, and join what is similar."""
        candidates = keep(pairs)
        if self.sequences is None:
            wanted = candidates.select(F.col("u").alias("id")).union(candidates.select("v")).distinct()
            sequences = keep(self.fetched(wanted))
        else:
            sequences = self.sequences
        with arrow_rows(pairs.sparkSession, PAIRS_AT_ONCE):
            first = sequences.select(F.col("id").alias("u"), F.col("sequence").alias("a"))
            second = sequences.select(F.col("id").alias("v"), F.col("sequence").alias("b"))
            judged = keep(
                candidates.join(first.hint("shuffle_merge"), "u")
                .join(second.hint("shuffle_merge"), "v")
                .select("u", "v", _alike(F.col("a"), F.col("b")).alias("alike"))
            )
        found = judged.filter("alike").select("u", "v")
        if not found.isEmpty():
            self._join(found)

    def _join(self, found: DataFrame) -> None:
        """Components with the new links: only what they join is looked at again."""
        if self.named is None:
            self.named = components(found)
            return
        ends = found
        for end in ("u", "v"):
            names = self.named.select(F.col("node").alias(end), F.col("component").alias("name"))
            joined = ends.join(names.hint("shuffle_merge"), end, "left")
            ends = joined.withColumn(end, F.coalesce("name", end)).drop("name")
        merged = keep(components(ends))
        names = merged.select(F.col("node").alias("component"), F.col("component").alias("name"))
        old = self.named.join(names.hint("shuffle_merge"), "component", "left").select(
            "node", F.coalesce("name", "component").alias("component")
        )
        new = merged.join(self.named.select("node").hint("shuffle_merge"), "node", "left_anti")
        self.named = keep(old.unionByName(new.select("node", "component")))

    def run(self) -> DataFrame:
        """(node, component) of all texts that have a near copy."""
        rest = self.buckets()
        if not rest.isEmpty():
            rest = self.open(self.first_round(rest))
        if not rest.isEmpty():
            rest = keep(self.hopeful(rest))
        if not rest.isEmpty():
            self.mapped(rest)
        pivots = PIVOTS
        while not rest.isEmpty():
            rest = self.open(self.compare(rest, pivots))
            pivots *= 2
        if self.named is None:
            return self.texts.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
        return self.named


def _classified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's sketches; of every word sequence (content) what stays and the rows of its class."""
    sketched = keep(
        rows.select("doc_id", F.col("__at").alias("at"), _sketched(F.col("text")).alias("s")).select("doc_id", "at", "s.*")
    )
    classes = keep(
        sketched.filter("n > 0")
        .groupBy("content")
        .agg(
            F.max(F.struct("doc_id", "at")).alias("stays"),
            F.count("*").alias("rows"),
            F.first("n").alias("n"),
            F.first("sketches").alias("sketches"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )

    def sequences(wanted: DataFrame) -> DataFrame:
        places = keep(classes.join(wanted, "id", "left_semi").select("id", F.col("stays.at").alias("__at")))
        texts = checked_join(rows.select("__at", "text"), places, "__at", "inner", 192)
        return texts.select("id", _sequence(F.col("text")).alias("sequence"))

    named = _Classes(classes.select("id", "n", "sketches"), sequences).run()
    grouped = classes.drop("sketches").join(named.withColumnRenamed("node", "id").hint("shuffle_merge"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    whole = grouped.groupBy("component").agg(F.max("stays").alias("stays"), F.sum("rows").alias("rows"))
    final = keep(
        grouped.select("content", "component").join(whole.hint("shuffle_merge"), "component").select("content", "stays", "rows")
    )
    return sketched, final


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = located(docs)
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        sketched, final = _classified(rows)
    judged = sketched.select("doc_id", "at", "content", "n").join(final.hint("shuffle_merge"), "content", "left")
    alone = F.col("n") == 0
    return rows, judged.select(
        "doc_id",
        "at",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("rows")).cast("long").alias("class_size"),
        (alone | F.col("at").eqNullSafe(F.col("stays.at"))).alias("kept"),
    )


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept."""
    _, judged = _judged(docs)
    return judged.drop("at")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; columns as they were."""
    rows, judged = _judged(docs)
    dropped = keep(judged.filter("NOT kept").select(F.col("at").alias("__at")))
    return restored(checked_join(rows, dropped, "__at", "left_anti", 160), docs)
