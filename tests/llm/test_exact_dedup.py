import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm.exact_dedup import drop_copies, exact_dedup
from tests.llm.frames import ODD_TEXTS, as_tuples, documents


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[lowered(text)].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for key in keys:
            kept = key == keep and first
            first = first and not kept
            out.append((key, keep, len(keys), kept, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ODD_TEXTS, ODD_TEXTS[:1], []])
def test_groups_of_equal_texts(spark, rows):
    found = exact_dedup(documents(spark, rows))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert as_tuples(found) == expected(rows)


def test_colliding_digests_do_not_merge_texts(spark):
    docs = documents(spark)
    poor = exact_dedup(docs, digest=lambda text: F.substring(text.cast("binary"), 1, 1)).drop("text_sha256")
    assert as_tuples(poor) == as_tuples(exact_dedup(docs).drop("text_sha256"))


def test_small_micro_batches_give_the_same_state(spark):
    docs = documents(spark).repartition(5)
    assert as_tuples(exact_dedup(docs, batch_bytes=1)) == expected(ODD_TEXTS)


def test_dropping_keeps_columns_and_one_row_a_text(spark):
    docs = documents(spark)
    kept = drop_copies(docs)
    assert kept.schema == docs.schema
    assert len({lowered(r.text) for r in kept.collect()}) == kept.count()
    assert {lowered(r.text) for r in kept.collect()} == {lowered(t) for _, t in ODD_TEXTS}
