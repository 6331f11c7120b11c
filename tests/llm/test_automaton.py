import random
import re

import pytest

from fleetgauge.llm.automaton import Rule, anchored, scanner
from fleetgauge.llm.secret_scan import BASE, MORE, compiled, scan_secrets
from tests.llm.frames import ODD_TEXTS, documents

BRUTE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ("forge", re.compile("gh[pousr]_([A-Za-z0-9]+)"), lambda m: len(m[1]) >= 36),
    ("chat", re.compile(r"xox[abprs]-([A-Za-z0-9\-]+)"), lambda m: len(m[1]) >= 10),
    ("pem", re.compile("-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"), lambda m: True),
]
PARTS = [
    "password", "Token", "SECRET", "api_key", "apikey", "passwd", " ", "=", ":", '"', "'", "AKIA", "AKIAAKIA",
    "ABCDEF0123456789XYZW", "deadbeef", "0123456789abcdef", "abc", "é", "\n", "-", "x", "ghp_", "xoxb-", "zz zz",
    "A" * 36, "-----BEGIN RSA PRIVATE KEY-----", "--", "日",
]


def brute(text):
    return sorted(
        (m.start(), order, m.end())
        for order, (_, pattern, fits) in enumerate(BRUTE)
        for m in pattern.finditer(text)
        if fits(m)
    )


def test_spans_equal_the_regex_engine():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "token=" + "a" * 50_000, "deadbeef" * 30_000]
    assert compiled(BASE + MORE).spans([t.encode() for t in texts]) == [brute(t) for t in texts]


def test_every_row_has_its_spans(spark):
    rows = [*ODD_TEXTS, (50, "é token: abcdef"), (51, "token=token: abcdefgh")]
    found = scan_secrets(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    assert spans[50] == [("assign", 2, 15)]
    assert spans[51] == []
    assert scan_secrets(documents(spark, [])).collect() == []
    assert [tuple(r) for r in scan_secrets(documents(spark, [(None, None)])).collect()] == [(None, [])]


def test_anchored_and_reversed():
    pattern = [("ab?(c|dd)+", False)]
    forward, back = anchored(*pattern), anchored(*pattern, backwards=True)
    assert forward.longest(b"abcddcx") == 6 and forward.longest(b"b") == -1
    assert back.longest(b"cddcba") == 6


def test_a_rule_that_needs_to_go_back_is_refused():
    with pytest.raises(ValueError):
        scanner([Rule("x", "", "a(bc)?")])
