import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import cover_tree, vector_links
from fleetgauge.llm.cover_tree import CoverTree, joined, traverse, unit

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, key int, block long"


def clumps(seed, count, dim=16, spread=0.05):
    """Unrelated points and clumps around some of them, of very unlike sizes."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count, dim))
    own = np.r_[np.zeros(count // 2, int), rng.integers(0, count, count)]
    near = centres[own] + spread * np.linalg.norm(centres[own], axis=1, keepdims=True) * rng.standard_normal((len(own), dim)) / 2
    return np.concatenate([centres, near]).astype(np.float32)


def brute(rows, cosine=0.98):
    """vec_id, n_links, component_id, kept of rows of (vec_id, vector, label)."""
    n = len(rows)

    def good(r):
        vector = r[1]
        return r[2] is not None and vector is not None and all(v is not None and np.isfinite(v) for v in vector) and any(vector)

    least = list(range(n))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    least[root(i)] = root(j)
    names = {}
    for i in range(n):
        names.setdefault(root(i), []).append(rows[i][0])
    named = [min((v for v in names[root(i)] if v is not None), default=None) for i in range(n)]
    return sorted(((r[0], k, c, r[0] == c) for r, k, c in zip(rows, links, named, strict=True)), key=str)


def frame(spark, rows):
    wide = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, 2) for i, v, label in rows]
    return spark.createDataFrame(wide, SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("leaf", [1, 4, 32])
@pytest.mark.parametrize("dim", [2, 16, 64])
def test_traversal_finds_every_pair(dim, leaf):
    points = unit(clumps(dim, 120, dim))
    one, two = points[:130], points[130:]
    ones, twos = np.arange(1, len(one) + 1), np.arange(2, len(two) + 2)
    trees = CoverTree(one, leaf), CoverTree(two, leaf)
    links = traverse(*trees, 0.98, (ones, twos))
    expected = one @ two.T >= 0.98
    assert expected.any()
    assert (links.counts[0] == expected @ twos).all() and (links.counts[1] == ones @ expected).all()
    own = traverse(trees[0], trees[0], 0.98, (ones, ones))
    expected = (one @ one.T >= 0.98) & ~np.eye(len(one), dtype=bool)
    assert (own.counts[0] + own.counts[1] == expected @ ones).all()
    least = joined(own.edges, len(one))
    for i, j in np.argwhere(expected):
        assert least[i] == least[j] <= i


def test_levels_cover_and_separate():
    points = unit(clumps(5, 400, 3))
    tree = CoverTree(points, 4)
    for node, children in enumerate(tree.children):
        members = tree.members(node)
        far = np.linalg.norm(points[members] - tree.centres[node], axis=1)
        assert far.max() <= tree.radii[node] + 1e-12
        if children is not None:
            assert sorted(np.concatenate([tree.members(c) for c in children])) == sorted(members)
            assert tree.centre[children[0]] == tree.centre[node]
            centres = tree.centres[children]
            between = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(children), dtype=bool)]
            width = 2.0 ** np.floor(np.log2(between.min(initial=2.0)))
            assert tree.radii[children].max() <= 2 * width


def test_bounds_prune(monkeypatch):
    """Clumps that are far apart are not compared point by point."""
    rng = np.random.default_rng(3)
    centres = np.eye(8)[np.repeat(np.arange(8), 200)]
    points = unit(centres + 0.3 * rng.standard_normal(centres.shape) / np.sqrt(8))
    seen = []
    decided = cover_tree._decided
    monkeypatch.setattr(cover_tree, "_decided", lambda *a: seen.append(a[4].size) or decided(*a))
    tree = CoverTree(points)
    links = traverse(tree, tree, 0.98, (np.ones(len(points), int),) * 2)
    assert links.counts[0].sum() == (np.triu(points @ points.T, 1) >= 0.98).sum()
    assert sum(seen) < len(points) ** 2 / 6


@pytest.mark.parametrize("block_bytes", [2_000, vector_links.BLOCK_BYTES])
def test_against_brute_force(spark, block_bytes):
    vectors = clumps(11, 60)
    rows = [(int(i * 37 % 991), v, int(i % 3 == 0)) for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[0], 0) for i in range(30)]
    df = vector_links.near_vectors(frame(spark, rows), block_bytes=block_bytes)
    assert df.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert found(df) == brute(rows)


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.98, np.sqrt(1 - 0.98**2), 0.0]
    rows = [
        (1, a, 0), (2, [2.0, 0.0, 0.0], 0), (3, [3e-30, 0.0, 0.0], 0), (4, a, 1), (5, a, None), (6, None, 0),
        (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 0.0], 0), (9, [1.0, float("nan"), 0.0], 0),
        (10, [float("inf"), 0.0, 0.0], 0), (11, [1.0, 0.0], 0), (12, [], 0), (13, [1.0, -0.0, 0.0], 0),
        (14, b, 2), (15, a, 2), (16, [-1.0, 0.0, 0.0], 0), (3, [3e-30, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.0], 0),
        (None, a, 0), (None, [0.0, 0.0, 1.0], 0), (None, None, None), (20, a, 0), (20, a, 0),
    ]
    assert found(vector_links.near_vectors(frame(spark, rows))) == brute(rows)
    assert found(vector_links.near_vectors(frame(spark, rows[4:5]))) == [(5, 0, 5, True)]
    assert vector_links.near_vectors(frame(spark, [])).collect() == []


def test_doubles_and_the_limit(spark):
    """A cosine of 0.98 or just above links, just below does not."""
    def at(cosine):
        return [cosine, float(np.sqrt(1 - cosine * cosine))]

    rows = [(1, [1.0, 0.0], 0), (2, at(0.98 + 1e-12), 0), (3, [1.0, 0.0], 1), (4, at(0.98 - 1e-12), 1), (5, [0.0, 1.0], 2), (6, [7.0, 24.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(vector_links.near_vectors(df)) == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
    ]


def test_text_labels_and_a_frequent_vector(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(1) - 0.5, F.rand(2) - 0.5)).alias("embedding"),
        F.lit("one").alias("label"),
    )
    got = vector_links.near_vectors(rows, block_bytes=4000).filter("vec_id % 3 = 0").agg(F.min("n_links"), F.max("n_links")).first()
    assert got[0] == got[1] >= 999


def test_given_vectors_against_brute_force(spark):
    """A part of the given table, by numpy over all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("label = 1")
    rows = df.orderBy("vec_id").collect()
    points = unit(np.array([r.embedding for r in rows]))
    near = points @ points.T >= 0.98
    got = {r.vec_id: r for r in vector_links.near_vectors(df, block_bytes=64 << 10).collect()}
    assert [got[r.vec_id].n_links for r in rows] == (near.sum(axis=1) - 1).tolist()
    least = joined([np.argwhere(near).T], len(rows))
    assert [got[r.vec_id].component_id for r in rows] == [rows[i].vec_id for i in least]
