import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ref int, seq long"


def brute(rows):
    """The trie of rows of (conv_id, turn, role, text), by materialised sequences."""
    own = {}
    for c, turn, role, text in sorted(
        (r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    ):
        own.setdefault(c, []).append((role or "", text or ""))

    def base(c):
        return c - (abs(c) % 100) * (1 if c >= 0 else -1)

    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(base(c), [])[:h] + own[c][h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, found in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in found if rebuilt[c] == node)
        out.append(
            (
                min(found),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(found),
                len(children.get(node, [])),
                sum(x not in children for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, count, most=9):
    """Conversations with common beginnings; many share a base, some bases are missing or short."""
    rng = random.Random(seed)
    ids = rng.sample(range(-150, 900), count) + [0, 100, 1]
    rows = []
    for c in set(ids) - {200, 300}:
        for turn in range(rng.randrange(1, most)):
            text = f"t{turn} {rng.choice('aab')}" * rng.randrange(1, 3)
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn % 3 == 2 else "user", text))
    return rows


ODD = [
    (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "é\U0001f600"), (1, 0, "a", "x"), (2, 5, "user", "b"),
    (2, 5, "user", "b"), (2, -1, None, "b"), (None, 0, "user", "lost"), (None, None, None, None), (100, 0, "", ""),
    (100, 1, None, None), (107, 3, "user", "only"), (205, 1, "u", "z" * 50_000), (206, 1, "u", "z" * 50_000),
    (-3, 0, "u", "neg"), (-203, 0, "u", "neg"), (-200, 0, "u", "base"), (-200, 1, "u", "base"),
]


def test_against_brute_force(spark):
    rows = made(3, 250)
    df = trie.prefix_trie(frame(spark, rows))
    assert df.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    assert {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    assert found(df) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    assert found(trie.prefix_trie(frame(spark, ODD))) == brute(ODD)
    assert trie.prefix_trie(frame(spark, [])).collect() == []
    assert trie.prefix_trie(frame(spark, ODD[7:9])).collect() == []


def test_turnless(spark):
    """A conversation with fewer own turns than it replaces, and no base, ends at the root."""
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 0, "user", "gone")]
    got = found(trie.prefix_trie(frame(spark, rows)))
    assert got == brute(rows) and got[0][:6] == (short, 0, None, 1, 0, 1)


def test_collisions_change_nothing(spark):
    """A digest with few values, and a first base under which unlike sequences collide."""
    rows = made(5, 60)
    weak = trie.Letters((0, 0, 0, 0), 1)
    calls = []
    drawn = trie.Letters.drawn(101)

    def poor(role, text):
        return F.unhex(F.substring(F.sha2(text, 256), 1, 1))

    products = trie._products
    try:
        trie._products = lambda turns, letters: calls.append(letters) or products(turns, letters)
        got = found(trie.prefix_trie(frame(spark, rows), digest=poor, tries=(weak, drawn)))
    finally:
        trie._products = products
    assert calls == [weak, drawn]
    assert got == brute(rows)
    with pytest.raises(RuntimeError):
        trie.prefix_trie(frame(spark, rows), tries=(weak,))


def test_long_conversation_in_pieces(spark):
    """Two conversations hold nearly all turns; ranges cut them and their products are combined."""
    rows = made(7, 5) + [(c, i, "user", f"{i % 7}") for c, most in ((400, 250), (401, 240)) for i in range(most)]
    df = frame(spark, rows).repartition(4)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        cut = trie._stored(df, trie._sha256).filter("conv_id = 400").selectExpr("shiftright(seq, 33) AS p").distinct()
        assert cut.count() > 1
        assert found(trie.prefix_trie(df)) == brute(rows)
    finally:
        spark.conf.unset(name)


def test_many_copies(spark):
    """A third of the conversations are alike: their ends are one digest."""
    rows = [(1000 * 100 + c * 100, t, "u", f"{t}") for c in range(400) for t in range(2)] + made(9, 40)
    assert found(trie.prefix_trie(frame(spark, rows))) == brute(rows)
