"""Secret scan: all rules in one pass of a combined deterministic automaton over the bytes.

The rules are compiled once into transition arrays (``automaton.scanner``), which are small
and broadcast. A task scans its texts in lanes: the bytes of many texts are laid end to end
and cut where the automaton is sure to be at its start (bytes that lead there from every
state; a separator follows every text), and numpy moves all lanes one byte a step. An event
gives the end of a match; its start is found by the rule's reversed automaton, longest match
backwards, not before the rule's last match.

Defined cases: a null text is empty and has no spans. Spans are in code points, ends
exclusive, ordered by start, then by the order of the rules. Matches of one rule never
overlap; a match that is too short is dropped and its bytes are not searched again. Repeated
rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetgauge.llm.automaton import BYTES, Dfa, Rule, anchored, scanner
from fleetgauge.llm.shared import text_rows

#: The three base rules.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        "[A-Za-z0-9+/_.=\\-]+",
        least_body=6,
        ignore_case=True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    Rule("hex", "", "[0-9a-f]{24,}", least=24),
)

#: Further kinds: a platform's tokens, a chat service's tokens, the first line of a private key.
MORE = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]+", least_body=36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9\\-]+", least_body=10),
    Rule("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", ""),
)

LANES = 4096
#: A byte that ends every match; UTF-8 texts don't hold it.
SEPARATOR = 0xFF


class Scanner:
    """Compiled rules; ``spans`` finds their matches in many texts."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        self.dfa: Dfa = scanner(list(self.rules))
        pairs = [[(r.head, r.ignore_case), (r.body, False)] for r in self.rules]
        self.starts = [anchored(*p, backwards=True) for p in pairs]
        self.heads = [anchored(p[0]) for p in pairs]
        steps = self.dfa.table.reshape(-1, BYTES)
        home = {0, *np.flatnonzero(self.dfa.accepts)}
        start_row = steps[0]
        # After such a byte the search goes on as from the start, whatever was read before.
        same = [s for s in home if np.array_equal(steps[s], start_row)]
        self.resets = np.isin(steps, same).all(axis=0)
        self.first_event = len(steps) - int((self.dfa.accepts != 0).sum())

    def _events(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place just after each match, state entered there) in order of place."""
        cuts = np.flatnonzero(self.resets[data]) + 1
        aim = np.arange(1, LANES) * (len(data) // LANES)
        begins = np.unique(np.concatenate([[0], cuts[np.minimum(np.searchsorted(cuts, aim), len(cuts) - 1)]]))
        begins = begins[begins < len(data)]
        lengths = np.diff(np.append(begins, len(data)))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        state = np.zeros(len(begins), np.int32)
        table, first = self.dfa.table, self.first_event
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left") if len(lengths) else []
        places, states = [], []
        for step, n in enumerate(live):
            at = begins[:n] + step
            now = table[state[:n] * BYTES + data[at]]
            state[:n] = now
            if int(now.max()) >= first:
                hit = np.flatnonzero(now >= first)
                places.append(at[hit])
                states.append(now[hit])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        place, entered = np.concatenate(places), np.concatenate(states)
        order = np.argsort(place, kind="stable")
        return place[order], entered[order]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, number of the rule, end), in order, in code points."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
        places, states = self._events(data)
        last = [(-1, 0)] * len(self.rules)
        for place, state in zip(places.tolist(), states.tolist(), strict=True):
            row = int(np.searchsorted(ends, place, side="right"))
            end = place - int(ends[row] - lengths[row])
            bits = int(self.dfa.accepts[state])
            for i, rule in enumerate(self.rules):
                if not bits >> i & 1:
                    continue
                low = last[i][1] if last[i][0] == row else 0
                last[i] = (row, end)
                text = texts[row]
                start = end - self.starts[i].longest(_Backwards(text, low, end))
                head = self.heads[i].longest(text[start:end]) if rule.head else 0
                if end - start >= rule.least and end - start - head >= rule.least_body:
                    found[row].append((start, i, end))
        for text, spans in zip(texts, found, strict=True):
            spans.sort()
            if not text.isascii():
                spans[:] = [(len(text[:a].decode()), i, len(text[:b].decode())) for a, i, b in spans]
        return found


class _Backwards:
    """The bytes of ``text[low:end]`` from the last to the first, without a copy."""

    def __init__(self, text: bytes, low: int, end: int):
        self.text, self.low, self.end = text, low, end

    def __iter__(self):
        return (self.text[i] for i in range(self.end - 1, self.low - 1, -1))


@cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan_secrets(docs: DataFrame, rules: Iterable[Rule] = BASE + MORE) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, end)."""
    rules = tuple(rules)
    shipped = docs.sparkSession.sparkContext.broadcast(compiled(rules))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = [rule.kind for rule in rules]
        for ids, texts in text_rows(batches):
            spans = [
                [{"kind": kind_of[i], "start": a, "end": b} for a, i, b in row] for row in shipped.value.spans(texts)
            ]
            columns = [ids, pa.array(spans, pa.list_(arrow_span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
