import random
import tracemalloc

import numpy as np
import pytest

from fleetgauge.llm import near_dedup as nd
from fleetgauge.llm.components import components
from fleetgauge.llm.decontaminate import Words
from tests.llm.frames import LONG, ODD_TEXTS, documents


def sequence(text):
    return Words([text.encode()]).hash


def shingle_sets(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    one, two = shingle_sets(a), shingle_sets(b)
    return len(one & two) / len(one | two)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"more{rng.randrange(10**6)}")
    return words


def test_texts_with_most_shingles_in_common_are_similar():
    rng = random.Random(2)
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 200))]
        one, two = " ".join(words), " ".join(edited(rng, words, rng.randint(0, 40)))
        found, true = nd.similarity(sequence(one), sequence(two)), jaccard(one, two)
        assert found >= 0.8 if true >= 0.8 else true >= 0.5 or found == 0


def test_the_share_of_shingles_decides(spark):
    rows, apart = [], []
    for every in (10, 15, 17):
        words = [f"w{every}x{i}" for i in range(300)]
        other = [f"{w}new" if i % every == every // 2 else w for i, w in enumerate(words)]
        one, two = " ".join(words), " ".join(other)
        apart.append(jaccard(one, two))
        assert nd.similarity(sequence(one), sequence(two)) == 0
        rows += [(len(rows), one), (len(rows) + 1, two)]
    assert min(apart) < 0.5 and 0.5 < max(apart) < 0.75
    assert all(r.class_size == 1 for r in nd.near_classes(documents(spark, rows)).collect())
    words = [f"w{i}" for i in range(124)]
    # 96 of 120 shingles, exactly at the limit.
    assert nd.similarity(sequence(" ".join(words)), sequence(" ".join(words[:100]))) == 0.8


def test_the_chain_is_a_longest_one():
    rng = random.Random(8)
    for _ in range(200):
        values = [rng.randrange(30) for _ in range(rng.randint(0, 25))]
        longest = [1] * len(values)
        for i, value in enumerate(values):
            longest[i] += max((longest[j] for j in range(i) if values[j] < value), default=0)
        chain = [values[i] for i in nd.longest_rising(values)]
        assert all(x < y for x, y in zip(chain, chain[1:]))
        assert len(chain) == max(longest, default=0)


def test_moved_blocks_are_not_similar():
    words = [f"w{i}" for i in range(400)]
    assert nd.similarity(sequence(" ".join(words)), sequence(" ".join(words[200:] + words[:200]))) < 0.8


def test_sketches_keep_the_order():
    words = sequence(" ".join(f"w{i}" for i in range(300)))
    same = np.array(nd.order_sketches(nd.shingles(words)))
    other = np.array(nd.order_sketches(nd.shingles(np.r_[words[150:], words[:150]])))
    assert (same == other).mean() < 0.8


def clusters(seed=3):
    """Texts, and the class of each: bases with edited copies, fresh texts, one common passage."""
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(60))
    rows, truth = [], {}
    for cluster in range(40):
        words = [f"c{cluster}x{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        for copy in range(rng.choice([1, 1, 2, 5])):
            key = len(rows)
            rows.append((key, " ".join(edited(rng, words, 1) if copy else words)))
            truth[key] = cluster
    for extra in range(80):
        key = len(rows)
        rows.append((key, passage + " " + " ".join(f"e{extra}x{rng.randrange(10**6)}" for _ in range(40))))
        truth[key] = 1000 + extra
    return rows, truth


@pytest.mark.parametrize("pivots", [nd.PIVOTS, 1])
def test_classes_of_edited_copies(spark, monkeypatch, pivots):
    monkeypatch.setattr(nd, "PIVOTS", pivots)
    rows, truth = clusters()
    found = {r.doc_id: r for r in nd.near_classes(documents(spark, rows).repartition(3)).collect()}
    expected = {key: max(k for k, c in truth.items() if c == own) for key, own in truth.items()}
    assert {k: r.class_id for k, r in found.items()} == expected
    assert sum(r.kept for r in found.values()) == len(set(truth.values()))


def given_classes(spark, texts, sketches):
    """Classes of texts with made-up sketches."""
    rows = [(i, len(text.split()), sketches(i)) for i, text in enumerate(texts)]
    classes = spark.createDataFrame(rows, "id long, n long, sketches array<long>")
    given = [(i, sequence(text).tobytes()) for i, text in enumerate(texts)]
    sequences = spark.createDataFrame(given, "id long, sequence binary")
    return nd._Classes(classes, lambda wanted: sequences.join(wanted, "id", "left_semi"))


@pytest.mark.parametrize("common, linked", [(4, True), (3, False)])
def test_the_same_sketches_are_asked_for_in_a_large_bucket(spark, monkeypatch, common, linked):
    monkeypatch.setattr(nd, "PIVOTS", 1)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words), " ".join(edited(rng, words, 1))]
    texts += [" ".join(f"o{i}x{k}" for k in range(150)) for i in range(12)]

    def sketches(i):
        # All share the first ``common`` sketches; the others also share a further one, so one of them is the first pivot.
        return [*range(common), 77 if i > 1 else 100 + i, *(1000 * (i + 1) + k for k in range(common + 1, 20))]

    found = given_classes(spark, texts, sketches).run().collect()
    assert {r.node: r.component for r in found} == ({0: 0, 1: 0} if linked else {})


def test_rounds_write_no_squares(spark, monkeypatch):
    """Copies too far from each other: their own shingles tell it, so they aren't compared pair by pair."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(rng, words, 14)) for _ in range(120)] + [" ".join(edited(rng, words, 1)) for _ in range(30)]
    classes = given_classes(spark, texts, lambda i: list(range(20)))
    seen = []
    verify = nd._Classes._verify

    def counted(self, pairs):
        seen.append(pairs.count())
        verify(self, pairs)

    monkeypatch.setattr(nd._Classes, "_verify", counted)
    found = {r.node: r.component for r in classes.run().collect()}
    assert {found.get(i, i) for i in range(120, 150)} == {120}
    assert sum(seen) <= 4 * len(texts)


def test_no_more_bits_differ_than_shingles():
    rng = random.Random(14)
    for _ in range(100):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(40, 400))]
        parts = [sequence(" ".join(w)) for w in (words, edited(rng, words, rng.randint(1, 30)))]
        one, two = (nd.labelled(nd.shingles(w)) for w in parts)
        unlike = np.bitwise_count((nd.parity_map(one) ^ nd.parity_map(two)).view(np.uint64)).sum()
        assert unlike <= len(np.setxor1d(one, two))
        if nd.similarity(*parts):
            assert unlike * (1 + nd.SIMILARITY) <= (1 - nd.SIMILARITY) * (len(one) + len(two)) + 1e-6


def test_copies_just_too_far_are_not_aligned(spark, monkeypatch):
    """Each text could be similar to the unedited one, but not to another edited one."""
    rng = random.Random(16)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        own = list(words)
        for at in rng.sample(range(5, 195, 5), 4):
            own[at] = f"x{i}x{at}"
        texts.append(" ".join(own))
    seen = []
    verify = nd._Classes._verify

    def counted(self, pairs):
        seen.append(pairs.count())
        verify(self, pairs)

    monkeypatch.setattr(nd._Classes, "_verify", counted)
    expected, _ = true_classes(list(enumerate(texts)))
    found = {r.node: r.component for r in given_classes(spark, texts, lambda i: list(range(20))).run().collect()}
    names = {}
    for i in range(len(texts)):
        names.setdefault(found.get(i, i), []).append(i)
    assert {i: max(own) for own in names.values() for i in own} == expected
    assert sum(seen) <= 4 * len(texts)


def true_classes(rows):
    """Classes by the stated similarity of all pairs of different texts, each named by its largest id."""
    sequences = {}
    for key, text in rows:
        words = sequence(text or "")
        if len(words):
            sequences.setdefault(words.tobytes(), []).append(key)
    parts = [(np.frombuffer(k, np.uint64), v) for k, v in sequences.items()]
    holders = {}
    for i, (words, _) in enumerate(parts):
        for s in set(nd.shingles(words).tolist()):
            holders.setdefault(s, []).append(i)
    least = list(range(len(parts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    links = set()
    for i in range(len(parts)):
        near = set().union(*(h for s in set(nd.shingles(parts[i][0]).tolist()) if (h := holders[s])))
        for j in near:
            if j < i and nd.similarity(parts[i][0], parts[j][0]) >= 0.8:
                links.add((i, j))
                least[root(i)] = root(j)
    names = {}
    for i, (_, keys) in enumerate(parts):
        names.setdefault(root(i), []).extend(keys)
    alone = {key: key for key, text in rows if not len(sequence(text or ""))}
    return alone | {key: max(keys) for keys in names.values() for key in keys}, links


def recall(found, expected):
    """Share of the copies that should go which go."""
    going = [key for key, name in expected.items() if key != name]
    return sum(found[key] == expected[key] for key in going) / max(len(going), 1)


def test_given_documents_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected, links = true_classes([(r.doc_id, r.text) for r in df.collect()])
    found = {r.doc_id: r.class_id for r in nd.near_classes(df).collect()}
    assert len(links) > 3
    assert recall(found, expected) >= 0.95
    assert all(expected[found[key]] == expected[key] for key in found)


def test_a_common_passage_against_all_pairs(spark):
    """Copies of all distances around the limit, in texts that share a passage."""
    rng = random.Random(12)
    passage = [f"common{i}" for i in range(25)]
    rows = []
    for base in range(120):
        words = [f"b{base}x{rng.randrange(10**6)}" for _ in range(rng.randint(60, 160))]
        at = rng.randrange(len(words))
        words = words[:at] + passage + words[at:]
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), " ".join(edited(rng, words, rng.randrange(0, 7)))))
    expected, links = true_classes(rows)
    found = {r.doc_id: r.class_id for r in nd.near_classes(documents(spark, rows)).collect()}
    assert len(links) > 100
    assert recall(found, expected) >= 0.95
    # Nothing is joined that isn't linked.
    assert all(expected[found[key]] == expected[key] for key in found)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, words, 2))) for i in range(150)]
    found = nd.near_classes(documents(spark, [*rows, (999, " ".join(words))])).collect()
    assert {r.class_id for r in found} == {999} and {r.class_size for r in found} == {151}


def test_odd_rows(spark):
    rows = [*ODD_TEXTS, (30, LONG + " end"), (31, "one")]
    docs = documents(spark, rows)
    found = nd.near_classes(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.class_id, r.class_size, r.kept))
    assert by_id[8] == [(30, 2, False)] and by_id[30] == [(30, 2, True)]
    assert by_id[4] == [(31, 2, False)]
    assert by_id[1] == [(1, 1, True)] and by_id[2] == [(2, 1, True)]
    assert by_id[7] == [(7, 4, True)] and by_id[5] == [(7, 4, False)]
    kept = nd.drop_near_copies(docs)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in found)
    assert nd.near_classes(documents(spark, [])).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    names = {r.node: r.component for r in found}
    assert len(found) == len(names) == 41 + 40
    assert {names[i] for i in range(41)} == {0} and {names[i] for i in range(100, 140)} == {100}


def test_a_worker_holds_a_small_part_of_its_batch():
    texts = [" ".join(f"w{i}x{j}" for j in range(300)).encode() for i in range(2000)]
    tracemalloc.start()
    try:
        words = sum(len(part.hash) for _, part in nd._shards(texts))
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()
    assert words == 600_000


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, classified = [], nd._classified

    def run(rows):
        seen.append(int(spark.conf.get(name)))
        return classified(rows)

    monkeypatch.setattr(nd, "_classified", run)
    before = spark.conf.get(name)
    assert nd.near_classes(documents(spark)).count() == len(ODD_TEXTS)
    assert seen == [nd.TEXTS_AT_ONCE] and spark.conf.get(name) == before
