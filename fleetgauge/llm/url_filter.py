"""URL filter: a trie over reversed host labels and path segments.

The rules are put into one trie, whose edges are host labels from the top-level label
inwards and then complete path segments; the part of a rule's path after its last slash is
kept at its node as a prefix. The trie is broadcast (it holds the rules, whose number is
checked) and every url walks it once. Of all rules on the way the longest wins: more host
labels first, then the longer path. A url without a rule gets the default verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path. A path is
compared as text, so ``/en/`` fits ``/en/x`` and not ``/en``; an empty path fits only rules
without a path. Of rules for the same host and path the last one counts. Repeated rows are
judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import LOWER, UPPER

#: Most rules of one trie: it goes to every executor.
MOST_RULES = 1_000_000

_LOWER = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def rule(verdict: str, pattern: str) -> Rule:
    """A rule from a pattern like ``example.com/en/``: its host ends at the first slash."""
    host, slash, path = pattern.partition("/")
    return Rule(verdict, host.translate(_LOWER), slash + path)


class Trie:
    """Nodes are dicts: ``hosts`` by label, ``paths`` by segment, ``ends`` by prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for entry in rules:
            self._add(entry)

    def _add(self, entry: Rule) -> None:
        node = self.root
        for label in reversed(entry.host.split(".")) if entry.host else ():
            node = node.setdefault("hosts", {}).setdefault(label, {})
        *segments, rest = entry.path.split("/")
        for segment in segments:
            node = node.setdefault("paths", {}).setdefault(segment, {})
        node.setdefault("ends", {})[rest] = (str(entry), entry.verdict)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, best = self.root, self._on_path(self.root, path)
        for label in reversed(host.split(".")) if host else ():
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            best = self._on_path(node, path) or best
        return best

    @staticmethod
    def _on_path(node: dict, path: str) -> tuple[str, str] | None:
        segments, best = path.split("/"), None
        for at, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                rest = "/".join(segments[at:])
                fits = [prefix for prefix in ends if rest.startswith(prefix)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get("paths", {}).get(segment) if at + 1 < len(segments) else None
            if node is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host with A-Z lower-cased, both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: the key, host, path, rule, verdict."""
    entries = list(rules)
    if len(entries) > MOST_RULES:
        raise ValueError(f"{len(entries)} rules; one trie takes {MOST_RULES}")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(entries))

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            found = []
            for text in urls:
                host, path = split_url(text)
                name, verdict = trie.value.longest(host, path) or (None, default)
                found.append((host, path, name, verdict))
            yield pd.DataFrame(found, columns=["host", "path", "rule", "verdict"])

    judged = F.pandas_udf(walk, "host string, path string, rule string, verdict string")
    return pages.select(F.col(key), judged(F.col(url)).alias("judged")).select(key, "judged.*")
