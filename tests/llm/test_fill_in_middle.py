import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import fill_in_middle as fim
from tests.llm.frames import documents

TEXTS = [
    (1, None),
    (2, ""),
    (3, "one line"),
    (4, "one line\n"),
    (5, "\n\n\n"),
    (6, "a\nb\r\nc\x0bd e\nf"),
    (7, "has <P> in it\nand more"),
    (8, "has <S>"),
    (9, "<M>"),
    (10, "日本語\ncafé — naïve\n\U0001f600\nend"),
    (11, "".join(f"line {i} é\n" for i in range(40_000))),
    (12, "x" * 300_000),
    (13, "< P>\n<Q>\n<p>"),
    (14, "same\ntext"),
    (14, "same\ntext"),
    (None, "no\nid"),
    (None, None),
    *[(100 + i, "".join(f"{i} {j}\n" for j in range(i % 9))) for i in range(60)],
]


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        form, out = "plain", text
    elif h4 % 100 < 50:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (out, text)]
    return (doc_id, len(units), form, *lengths, *sha, out)


def test_against_brute_force(spark):
    found = fim.fill_in_middle(documents(spark, TEXTS)).withColumn("text", fim.output_text(F.col("output")))
    rows = found.drop("output").collect()
    assert sorted(map(tuple, rows), key=str) == sorted((expected(*row) for row in TEXTS), key=str)
    assert {row.form for row in rows} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = documents(spark, [(i, "a\nb\nc") for i in range(400)])
    none = fim.fill_in_middle(docs, rate=0)
    assert none.filter("form <> 'plain'").isEmpty()
    some = fim.fill_in_middle(docs, rate=50, suffix_first=100).groupBy("form").count().collect()
    assert {row["form"]: 150 < row["count"] < 250 for row in some} == {"plain": True, "spm": True}


def test_empty_table(spark):
    assert fim.fill_in_middle(documents(spark, [])).collect() == []


@pytest.mark.parametrize("frame", [1, 2, 3, 7, 64])
def test_frames_are_seekable(frame):
    text = "ab\ncdé\n\n日本\nlast < <P <S".encode()
    stored = fim.Frames.of([text[:5], b"", text[5:]], frame)
    assert len(stored.frames) == -(-len(text) // frame)
    assert b"".join(stored.stream()) == text
    units = text.splitlines(keepends=True)
    assert stored.units[-1] == len(units)
    for unit in range(len(units) + 1):
        head = b"".join(units[:unit])
        assert stored.cut(unit) == (len(head), len(head.decode()))
    for start in range(len(text)):
        assert stored.find(b"<S", start) == text.find(b"<S", start)
        for end in range(start, len(text) + 1):
            assert b"".join(stored.stream(start, end)) == text[start:end]
    assert stored.find(b"<M", 0) == -1


def test_a_cut_opens_one_frame(monkeypatch):
    stored = fim.Frames.of([b"line\n" * 10_000], 1000)
    opened = []
    clear = fim.Frames._clear
    monkeypatch.setattr(fim.Frames, "_clear", lambda self, frame: opened.append(frame) or clear(self, frame))
    assert stored.cut(7_777) == (5 * 7_777, 5 * 7_777)
    assert opened == [38]


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
@pytest.mark.parametrize("frame", [1, 4, 64])
def test_round_trip_of_empty_sections(form, frame):
    text = fim.Frames.of([b"a\nb\nc\n"], frame)
    for low in (0, 2, 6):
        for high in (low, 6):
            output = fim.Frames.of(fim.arranged(text, form, low, high), frame)
            assert b"".join(fim.rebuilt(output, form)) == b"a\nb\nc\n"
