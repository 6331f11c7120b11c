import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm.decontaminate import Windows, drop_contaminated, search_shard, with_hits, without_spans
from fleetgauge.llm.fm_index import FmIndex, suffix_order
from fleetgauge.llm.shared import WORD
from tests.llm.frames import ODD_TEXTS, WORDS, documents

FIND = re.compile(WORD)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(text, items, window):
    words = FIND.findall(lowered(text))
    hit, found = set(), set()
    for item, other in items:
        own = FIND.findall(lowered(other))
        for start in range(max(1, len(own) - window + 1) if own else 0):
            part = own[start : start + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_hits_equal_a_plain_search(window):
    rng = random.Random(window)
    vocabulary = ["a", "B", "cé", "d", "e", "ñ", "X1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 12, 20])))) for i in range(12)]
    texts = ["", " . ", *(", ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(0, 80))) for _ in range(150))]
    texts = [t + " " + rng.choice(items)[1] + " zz" if rng.random() < 0.5 else t for t in texts]
    data, none = [t.encode() for t in texts], [None] * len(texts)
    found = search_shard(Windows(items, window), data, none)
    assert [(f["n_words"], f["n_hit"], f["items"]) for f in found] == [brute(t, items, window) for t in texts]
    first = search_shard(Windows(items[:6], window), data, none)
    assert search_shard(Windows(items[6:], window), data, first) == found


def test_index_searches_and_locates():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 5, 3000)
    symbols[[700, 701, 1500, 2999]] = 0
    order = suffix_order(symbols)
    assert sorted(order.tolist()) == list(range(3000))
    index = FmIndex(symbols, 5)
    phrases = [rng.integers(1, 5, n) for n in (1, 2, 3, 5, 8) for _ in range(20)]
    low, high = index.search(phrases)
    for phrase, a, b in zip(phrases, low, high, strict=True):
        at = sorted(index.locate(np.arange(a, b)).tolist()) if a < b else []
        assert at == [i for i in range(3000 - len(phrase) + 1) if (symbols[i : i + len(phrase)] == phrase).all()]


def test_rows_blocks_and_spans(spark):
    item = " ".join(WORDS[:12])
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, item.upper()), (3, None), (4, "!?")], "item_id int, text string")
    rows = [*ODD_TEXTS, (20, "Before. " + item.replace(" ", ", ") + "! After")]
    docs = documents(spark, rows)
    found = with_hits(docs, benchmark)
    assert found.columns == [*docs.columns, "hits"] and found.count() == len(rows)
    in_blocks = with_hits(docs, benchmark, block_bytes=1, shard_bytes=1)
    key = [F.col("doc_id"), F.col("text"), F.col("hits").cast("string")]
    assert sorted(map(str, in_blocks.select(*key).collect())) == sorted(map(str, found.select(*key).collect()))
    row = found.filter("doc_id = 20").first()
    assert (row.hits.n_words, row.hits.n_hit, row.hits["items"]) == (14, 12, ["1", "2"])
    assert without_spans(row.text, row.hits.spans) == "Before. ! After"
    assert drop_contaminated(docs, benchmark).schema == docs.schema
    assert {r.doc_id for r in drop_contaminated(docs, benchmark).collect()} == {1, 2, 3, 4, 8, 9, None}
    empty = benchmark.limit(0)
    assert drop_contaminated(docs, empty).count() == len(rows)
    assert with_hits(documents(spark, []), benchmark).count() == 0
