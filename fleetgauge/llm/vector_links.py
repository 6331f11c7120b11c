"""Near-duplicate vectors: all pairs of a label within a cosine, by dual traversal of cover trees.

Equal vectors of a label are one point that stands for all of them. The points of a label are cut
into blocks: fixed directions deal them into cells, small cells next to each other share a block,
and large ones are divided by a hash, so that blocks have a bounded size however the rows lie.
Each block becomes a cover tree, and so does each pair of blocks whose balls come near enough; a
pair of trees is traversed by one task, which gives the links of every point and the least point
it is joined to. Links are summed and joined points form components. No link is left out and
nothing is written per link.

The pairs of blocks of a label grow with the square of its blocks where no ball is far from
another, as with unrelated vectors of many dimensions; what is written for a pair is one row for
each of its points that has a link.

Defined cases: vectors that are null, zero, or hold a null, NaN or infinite component, and all
vectors whose label is null, have no links and are their own components. Vectors of different
lengths are not compared. Repeated rows are vectors like others and linked to each other. Of
equal ids all get the same component; a null id is larger than any other, and a component of null
ids only has a null name. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.components import components
from fleetgauge.llm.cover_tree import SLACK, CoverTree, joined, traverse, unit
from fleetgauge.llm.shared import arrow_rows, checked_join, keep

COSINE = 0.98
#: Bytes of the vectors of a block; it holds up to twice as many.
BLOCK_BYTES = 512 << 10
CELLS = 64
#: Pairs of blocks that a Python worker gets at once.
PAIRS_AT_ONCE = 4

_BALL = T.StructType(
    [
        T.StructField("keys", T.BinaryType()),
        T.StructField("weights", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("centre", T.BinaryType()),
        T.StructField("radius", T.DoubleType()),
    ]
)


@cache
def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, CELLS))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, dim)


@F.arrow_udf(T.IntegerType())
def _cell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Which of the fixed directions a vector is nearest to."""
    for vectors in batches:
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros(len(vectors), np.int32)
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            out[rows] = np.argmax(unit(_matrix(vectors.take(pa.array(rows)), dim)) @ _directions(dim), axis=1)
        yield pa.array(out)


def usable(label: str, vector: str):
    """Whether a row's vector can have a cosine with others of its label."""
    size = F.col(vector)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col(label).isNotNull() & size.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _dealt(points: DataFrame, block_bytes: int) -> DataFrame:
    """``points`` with the number of their block within the label."""
    celled = keep(points.withColumn("cell", _cell("vector")))
    width = 8 if points.schema["vector"].dataType.elementType == T.DoubleType() else 4
    rows = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (F.col("dim") * width)))
    counts = celled.groupBy("label", "dim", "cell").agg(F.count("*").alias("size")).withColumn("most", rows)
    # At most CELLS rows of counts a label: large cells take blocks of their own, small ones share.
    before = F.sum(F.least("size", "most")).over(
        _by_label().orderBy("cell").rowsBetween(-CELLS, -1)
    )
    places = keep(
        counts.select(
            "label",
            "dim",
            "cell",
            F.floor(F.coalesce(before, F.lit(0)) / F.col("most")).alias("block"),
            F.ceil(F.col("size") / F.col("most")).alias("parts"),
        )
    )
    placed = checked_join(celled, places, ["label", "dim", "cell"], "inner", 64)
    part = F.when(F.col("parts") > 1, F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("key"), "parts")).otherwise(-1)
    return placed.select("label", "dim", "block", part.alias("part"), "key", "weight", "vector")


def _by_label():
    from pyspark.sql import Window

    return Window.partitionBy("label", "dim")


def _blocks(points: DataFrame, block_bytes: int) -> DataFrame:
    """(label, dim, block, keys, weights, vectors, centre, radius): one row per block, kept."""
    dealt = _dealt(points, block_bytes)
    by_block = ["label", "dim", "block", "part"]
    sorted_rows = dealt.repartition(*by_block).sortWithinPartitions(*by_block)
    schema = T.StructType([dealt.schema["label"], T.StructField("dim", T.IntegerType()), *_BALL.fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            dim = table.column("dim")[0].as_py()
            vectors = _matrix(table.column("vector").combine_chunks(), dim)
            points = unit(vectors)
            centre = points[np.argmax(points @ points.mean(axis=0))]
            columns = [
                table.column("label").combine_chunks().slice(0, 1),
                pa.array([dim], pa.int32()),
                pa.array([np.asarray(table.column("key"), np.int64).tobytes()]),
                pa.array([np.asarray(table.column("weight"), np.int64).tobytes()]),
                pa.array([vectors.tobytes()]),
                pa.array([centre.tobytes()]),
                pa.array([float(np.linalg.norm(points - centre, axis=1).max())]),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in by_block), strict=True))
            start = 0
            for at in range(len(names) + 1):
                if at < len(names) and names[at] == name:
                    continue
                if at > start:
                    held.append(batch.slice(start, at - start))
                if at < len(names):
                    if held:
                        yield made()
                        held = []
                    name, start = names[at], at
        if held:
            yield made()

    packed = sorted_rows.mapInArrow(pack, schema)
    return keep(packed.withColumn("id", F.monotonically_increasing_id()))


def _pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """(a, b) of the blocks of a label, a <= b, whose balls allow a link."""
    most = float(np.sqrt(2 - 2 * cosine)) + SLACK

    @F.arrow_udf(T.BooleanType())
    def near(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, spread in batches:
            far = [
                np.linalg.norm(np.frombuffer(x) - np.frombuffer(y)) - s <= most
                for x, y, s in zip(a.to_pylist(), b.to_pylist(), spread.to_pylist(), strict=True)
            ]
            yield pa.array(far, pa.bool_())

    balls = blocks.select("label", "dim", "id", "centre", "radius")
    a, b = balls.alias("a"), balls.alias("b")
    both = a.join(b.hint("shuffle_merge"), ["label", "dim"]).filter("a.id < b.id")
    some = both.filter(near(F.col("a.centre"), F.col("b.centre"), F.col("a.radius") + F.col("b.radius")))
    return some.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


_FOUND = "key long, links long, least long"


def _traversed(batches: Iterator[pa.RecordBatch], cosine: float, single: str) -> Iterator[pa.RecordBatch]:
    def tree(row: dict, side: str):
        keys = np.frombuffer(row[f"keys_{side}"], np.int64)
        weights = np.frombuffer(row[f"weights_{side}"], np.int64)
        vectors = np.frombuffer(row[f"vectors_{side}"], np.dtype(single))
        return keys, weights, CoverTree(unit(vectors.reshape(len(keys), -1)))

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            keys, weights, one = tree(row, "a")
            if row["keys_b"] is None:
                found = traverse(one, one, cosine, (weights, weights))
                links, edges = found.counts[0] + found.counts[1], found.edges
            else:
                keys_b, weights_b, two = tree(row, "b")
                found = traverse(one, two, cosine, (weights, weights_b))
                links = np.concatenate(found.counts)
                edges = [np.stack([e[0], e[1] + len(keys)]) for e in found.edges]
                keys = np.concatenate([keys, keys_b])
            some = np.flatnonzero(links)
            least = keys[joined(edges, len(keys))]
            columns = [pa.array(c[some], pa.int64()) for c in (keys, links, least)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "links", "least"])


def _linked(blocks: DataFrame, cosine: float) -> DataFrame:
    """(key, links, least) of the points with links, once for each tree and pair of trees."""
    single = "<f8" if blocks.vectors_double else "<f4"
    content = ["keys", "weights", "vectors"]
    names = lambda side: [F.col(c).alias(f"{c}_{side}") for c in content]
    table = blocks.table
    own = table.select(*names("a"), *[F.lit(None).cast("binary").alias(f"{c}_b") for c in content])
    pairs = keep(_pairs(table, cosine))
    one = table.select(F.col("id").alias("a"), *names("a")).hint("shuffle_merge")
    two = table.select(F.col("id").alias("b"), *names("b")).hint("shuffle_merge")
    both = pairs.join(one, "a").join(two, "b").drop("a", "b")
    with arrow_rows(table.sparkSession, PAIRS_AT_ONCE):
        run = lambda batches: _traversed(batches, cosine, single)
        return keep(own.repartition(F.xxhash64("keys_a")).unionByName(both).mapInArrow(run, _FOUND))


class _Blocks:
    def __init__(self, points: DataFrame, block_bytes: int):
        self.vectors_double = points.schema["vector"].dataType.elementType == T.DoubleType()
        self.table = _blocks(points, block_bytes)


def near_vectors(
    vectors: DataFrame,
    *,
    cosine: float = COSINE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kind = vectors.schema["embedding"].dataType.elementType
    if kind not in (T.FloatType(), T.DoubleType()):
        raise TypeError(f"embeddings are arrays of float or double, not of {kind.simpleString()}")
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    good = keep(rows.filter(usable("label", "vector")))
    points = keep(
        good.groupBy("label", "vector")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
        .withColumn("dim", F.size("vector"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    found = _linked(_Blocks(points, block_bytes), cosine)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.filter("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    named = points.select("key", "label", "vector", "weight", "first_id")
    if not edges.isEmpty():
        named = named.join(components(edges).withColumnRenamed("node", "key"), "key", "left")
        named = named.withColumn("component", F.coalesce("component", "key"))
        least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = named.join(least.hint("shuffle_merge"), "component")
    else:
        named = named.withColumn("component_id", F.col("first_id"))
    judged = keep(
        named.join(links.hint("shuffle_merge"), "key", "left").select(
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            "component_id",
        )
    )
    linked = good.join(judged.hint("shuffle_merge"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable("label", "vector"), F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
