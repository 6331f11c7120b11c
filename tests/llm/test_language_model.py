import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import language_model as lm
from fleetgauge.llm.queries import op7_language_model
from fleetgauge.llm.shared import LOWER_BYTES, crc_mod
from tests.llm.frames import ODD_TEXTS, documents

FIND = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*FIND.findall((text or "").encode().translate(LOWER_BYTES)), b""]


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def base(rows):
    count = Counter()
    for key, text in rows:
        if not held_out(key):
            count.update(tokens(text))
    total = sum(count.values())
    below = total + 0.1 * (len(count) + 1)
    return count, total, [sum(math.log10((count[t] + 0.1) / below) for t in tokens(text)) for _, text in rows]


def scored(df, **options):
    held = crc_mod(F.col("doc_id"), 10) == 0
    model = lm.fit(df.select("doc_id", "text"), ~held, **options)
    return model, lm.score(df, model).collect()


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 300, 0])
def test_counts_and_base_scores(spark, frequent):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.collect()]
    count, total, scores = base(rows)
    model, found = scored(given, frequent=frequent)
    assert (model.known.tokens, model.known.types) == (total, len(count))
    by_id = {r.doc_id: r for r in found}
    for (key, text), score in zip(rows, scores, strict=True):
        row = by_id[key]
        assert row.n_tokens == len(tokens(text))
        assert row.n_known == sum(count[t] > 0 for t in tokens(text))
        assert row.base_score == pytest.approx(score, rel=1e-9)


def test_the_model_is_better_than_its_base_on_held_out_texts(spark):
    found = op7_language_model(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert len(found) > 50
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_probabilities_add_up_to_one():
    words = [f"w{i}" for i in range(700)]
    counts = [1000 - i for i in range(700)]
    known = lm.vocabulary(words, counts, 50, sum(counts), 700)
    weights = lm.begin_weights(known)
    rng = np.random.default_rng(1)
    weights = weights._replace(
        classes=rng.normal(size=weights.classes.shape).astype(np.float32),
        members=rng.normal(size=weights.members.shape).astype(np.float32),
    )
    last = np.r_[lm._word_hashes(words), lm.END, np.uint64(12345)]
    total = 0.0
    for token in last:
        batch = lm.batch_of(np.array([lm._word_hashes(["w3"])[0], token]), np.zeros(2, np.int64), known)
        value = lm.log10_model(weights, batch)[1]
        if batch.cls[1] == lm.CLASSES:
            count = known.counts[batch.place[1]] if batch.place[1] >= 0 else 0
            value += math.log10((count + 0.1) / (known.tail_tokens + 0.1 * (known.tail_types + 1)))
        total += 10**value
    assert total == pytest.approx(1, abs=1e-4)


def test_odd_rows(spark):
    count, total, scores = base(ODD_TEXTS)
    model, found = scored(documents(spark))
    assert len(found) == len(ODD_TEXTS) and model.known.tokens == total
    assert sorted(round(r.base_score, 6) for r in found) == sorted(round(s, 6) for s in scores)
    assert scored(documents(spark, []))[1] == []


def test_without_training_texts(spark):
    df = documents(spark)
    model = lm.fit(df.select("doc_id", "text"), F.lit(False))
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm.score(df, model).collect())


def test_a_token_is_looked_up_by_its_first_bits():
    """Few comparisons a token; hashes with equal first bits, and at both ends, are told apart."""
    known = lm.vocabulary([f"w{i}" for i in range(5000)], list(range(5000, 0, -1)), 7, 20_000_000, 5000)
    crowded = np.sort(np.r_[known.hashes, np.arange(40, dtype=np.uint64) << np.uint64(3), np.uint64(2**64 - 1)])
    crowded = np.unique(crowded)
    starts = np.arange(1 << lm.PREFIX, dtype=np.uint64) << np.uint64(64 - lm.PREFIX)
    known = known._replace(hashes=crowded, begin=np.r_[np.searchsorted(crowded, starts), len(crowded)])
    asked = np.r_[crowded[::-1], crowded + np.uint64(1), np.uint64(0), lm.END]
    places = {h: i for i, h in enumerate(crowded.tolist())}
    assert known.lookup(asked).tolist() == [places.get(h, -1) for h in asked.tolist()]
    assert known.lookup(np.empty(0, np.uint64)).tolist() == []
    assert np.diff(lm.vocabulary([f"w{i}" for i in range(5000)], [1] * 5000, 7, 0, 0).begin).max() < 8
