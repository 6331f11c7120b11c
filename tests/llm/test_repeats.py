import hashlib
import random
from collections import Counter

import pytest

from fleetgauge.llm.repeats import remove_repeats
from tests.llm.frames import ODD_TEXTS, as_tuples, documents


def expected(rows):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for (key, _), text in zip(rows, data, strict=True):
        mark = bytearray(len(text))
        for i in range(len(text) - 199):
            if count[text[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        spans = sum(1 for part in bytes(mark).split(b"\0") if part)
        kept = hashlib.sha256(bytes(b for b, m in zip(text, mark, strict=True) if not m)).hexdigest()
        out.append((key, len(text), sum(mark), spans, kept))
    return sorted(out, key=str)


def collection(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefé \n") for _ in range(2000))
    texts = ["x" * 199, "y" * 200, "z" * 201, "ab" * 300, ("abc" * 50 + "q") * 5, passage, passage]
    for _ in range(60):
        text = "".join(rng.choice("abcdefé \n") for _ in range(rng.randint(0, 500)))
        for _ in range(rng.randint(0, 3)):
            start, size, at = rng.randint(0, 1500), rng.choice([150, 190, 200, 201, 260, 400]), rng.randint(0, len(text))
            text = text[:at] + passage[start : start + size] + text[at:]
        texts.append(text)
    return list(enumerate(texts)) + ODD_TEXTS


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(
    "limits", [{}, {"most_known": 0, "marked_bytes": 0}, {"together": 1}, {"together": 3, "most_known": 0}]
)
def test_removed_bytes_equal_a_plain_count(spark, limits):
    rows = collection(1)
    found = remove_repeats(documents(spark, rows).repartition(3), **limits)
    assert as_tuples(found, *COLUMNS) == expected(rows)


def test_one_passage_in_most_texts(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, f"{rng.random():.15f} " * 8 + passage + f" {rng.random():.15f}" * 8) for i in range(150)]
    for together in (10, 1000):
        assert as_tuples(remove_repeats(documents(spark, rows), together=together), *COLUMNS) == expected(rows)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).collect() == []
