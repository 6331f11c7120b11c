import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm.queries import op1_toxicity
from fleetgauge.llm.toxicity import THRESHOLD, drop_toxic, fit, sample, train, with_score
from tests.llm.frames import ODD_TEXTS, documents

SYLLABLES = ["an", "er", "ti", "on", "the", "re", "st", "ing", "le", "ou"]


def corpus(count, seed, insults=("moronic", "pathetic", "worthless")):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(count):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(insults)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return train(*corpus(1200, 1))


def scores(spark, model, texts):
    rows = with_score(documents(spark, list(enumerate(texts))), model, into="p").select("doc_id", "p").collect()
    return [r.p for r in sorted(rows, key=lambda r: r.doc_id)]


def test_held_out_texts(spark, model):
    texts, labels = corpus(400, 2)
    found = scores(spark, model, texts)
    right = [(p >= THRESHOLD) == bool(y) for p, y in zip(found, labels, strict=True)]
    assert sum(right) / len(right) > 0.97


def test_unseen_misspellings_share_subwords(spark, model):
    texts, labels = corpus(400, 3, insults=("moronicc", "patheticc", "worthles"))
    found = scores(spark, model, texts)
    caught = [p >= THRESHOLD for p, y in zip(found, labels, strict=True) if y]
    false = [p >= THRESHOLD for p, y in zip(found, labels, strict=True) if not y]
    # Not one word of them was learned: what is caught is caught by shared subwords.
    assert sum(caught) / len(caught) > 0.5 and sum(false) / len(false) < 0.03


def test_odd_rows(spark, model):
    rows = with_score(documents(spark), model, into="p").collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.p <= 1 for r in rows)
    assert len({r.p for r in rows if not (r.text or "").strip()}) == 1
    assert with_score(documents(spark, []), model).count() == 0


def test_sample_is_bounded_and_by_id(spark):
    docs = documents(spark, [(i, "x" * 100) for i in range(50)] + ODD_TEXTS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None)], "doc_id long, toxic int")
    assert sample(docs, labels, F.lit(True), 20, 1 << 20).count() <= 20
    assert sample(docs, labels, F.lit(True), 1000, 500).count() <= 5
    again = [sorted(map(str, sample(docs.repartition(n), labels, F.lit(True), 20, 1 << 20).collect())) for n in (1, 4)]
    assert again[0] == again[1]


def test_a_long_text_takes_no_room_in_the_sample(spark):
    rows = [(i, f"some words {i}") for i in range(40)]
    first = spark.range(40).orderBy(F.xxhash64("id")).first().id
    docs = documents(spark, [(i, "long " * 300_000 if i == first else text) for i, text in rows])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert sample(docs, labels, F.lit(True), 100, 1_400_000).count() == 39
    assert sample(docs, labels, F.lit(True), 100, 24 << 20).count() == 39


def test_a_sample_of_one_class_is_an_error(spark):
    docs = documents(spark, [(i, "x" * (2000 if i % 2 else 10)) for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="lacks one"):
        fit(docs, labels, F.lit(True), most_bytes=1000)
    assert fit(docs, labels.filter("toxic = 0"), F.lit(True)).bias == float("-inf")


def test_without_labels_nothing_is_toxic(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.p for r in with_score(docs, fit(docs, labels, F.lit(True)), into="p").collect()} == {0.0}
    kept = drop_toxic(docs, labels, F.lit(True))
    assert kept.count() == len(ODD_TEXTS) and kept.schema == docs.schema


def test_query_columns(spark):
    found = op1_toxicity(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == 200 and found.filter("predicted <> int(score >= 0.7)").count() == 0
