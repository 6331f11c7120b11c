"""Byte automata: regular expressions to minimal deterministic transition arrays.

A small regular-expression language is parsed to a non-deterministic automaton over bytes:
literals, ``[...]`` classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}`` and ``{n,}``.
``scanner`` joins the searches of all rules by subset construction and minimises the result
by refinement, so that one pass over the bytes finds the ends of every rule's leftmost,
longest, non-overlapping matches.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BYTES = 256


class Nfa:
    """Empty moves and byte moves between numbered states."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.empty[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for s in states for on, to in self.moves[s] if byte in on})

    def reverse(self, start: int, end: int) -> tuple[Nfa, int, int]:
        turned = Nfa()
        for _ in self.empty:
            turned.state()
        for s, after in enumerate(self.empty):
            for to in after:
                turned.empty[to].append(s)
        for s, moves in enumerate(self.moves):
            for on, to in moves:
                turned.moves[to].append((on, s))
        return turned, end, start


class _Parser:
    def __init__(self, nfa: Nfa, pattern: str, ignore_case: bool):
        self.nfa, self.text, self.at, self.fold = nfa, pattern, 0, ignore_case

    def parse(self) -> tuple[int, int]:
        part = self._either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return part

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())
        start, end = self.nfa.state(), self.nfa.state()
        for first, last in parts:
            self.nfa.empty[start].append(first)
            self.nfa.empty[last].append(end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self._peek() and self._peek() not in "|)":
            first, last = self._repeated()
            self.nfa.empty[end].append(first)
            end = last
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        start, end = self._one()
        mark = self._peek()
        if not mark or mark not in "?*+{":
            return start, end
        after = self.at
        if mark == "{":
            low, comma, high = self.text[self.at + 1 : (stop := self.text.index("}", self.at))].partition(",")
            if high:
                raise ValueError("a repetition needs no upper end here")
            for _ in range(int(low) - 1):
                self.at = begin
                first, last = self._one()
                self.nfa.empty[end].append(first)
                start_last, end = first, last
            if comma:
                self.nfa.empty[end].append(start_last if int(low) > 1 else start)
            self.at = stop + 1
            return start, end
        self.at = after + 1
        outer, out = self.nfa.state(), self.nfa.state()
        self.nfa.empty[outer].append(start)
        self.nfa.empty[end].append(out)
        if mark in "?*":
            self.nfa.empty[outer].append(out)
        if mark in "*+":
            self.nfa.empty[end].append(start)
        return outer, out

    def _one(self) -> tuple[int, int]:
        if self._peek() == "(":
            self._take()
            part = self._either()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self._take()
            return part
        on = self._class() if self._peek() == "[" else frozenset([self._byte()])
        if self.fold:
            on |= {ord(c) for x in on if chr(x).isascii() for c in (chr(x).lower(), chr(x).upper())}
        start, end = self.nfa.state(), self.nfa.state()
        self.nfa.moves[start].append((on, end))
        return start, end

    def _class(self) -> frozenset[int]:
        self._take()
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self._take()
                high = self._byte()
            found.update(range(low, high + 1))
        self._take()
        return frozenset(found)

    def _byte(self) -> int:
        char = self._take()
        if char == "\\":
            char = self._take()
            if char == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(char) >= 0x80:
            raise ValueError("patterns are ASCII")
        return ord(char)


class Rule(NamedTuple):
    """``head`` then ``body``; a match counts if both are long enough."""

    kind: str
    head: str
    body: str
    least_body: int = 0
    least: int = 0
    ignore_case: bool = False


class Dfa(NamedTuple):
    """``table[state * 256 + byte]`` is the next state; ``accepts[state]`` a bit per rule."""

    table: np.ndarray
    accepts: np.ndarray

    def longest(self, data: bytes) -> int:
        """Length of the longest prefix that leads to an accepting state, or -1. State 0 starts, state 1 is dead."""
        state, best = 0, 0 if self.accepts[0] else -1
        for at, byte in enumerate(data):
            state = int(self.table[state * BYTES + byte])
            if state == 1:
                break
            if self.accepts[state]:
                best = at + 1
        return best


def _byte_classes(nfas) -> list[int]:
    """One byte of every class of bytes that no move tells apart, and each byte's class."""
    sets = {on for nfa in nfas for moves in nfa.moves for on, _ in moves}
    seen: dict[tuple, int] = {}
    return [seen.setdefault(tuple(b in on for on in sets), len(seen)) for b in range(BYTES)]


def minimised(steps: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, accepts, new number of each state) with equivalent states merged.

    States start apart if they accept differently and are split while their moves lead to
    different parts.
    """
    part = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        seen = np.column_stack([part, part[steps]])
        finer = np.unique(seen, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.unique(part, return_index=True)[1]
    return part[steps[first]], accepts[first], part


def anchored(pattern: tuple[str, bool], *parts: tuple[str, bool], backwards: bool = False) -> Dfa:
    """Automaton for prefixes that match the joined patterns; state 0 starts, 1 is dead."""
    nfa, start, end = _joined([pattern, *parts])
    if backwards:
        nfa, start, end = nfa.reverse(start, end)
    classes = _byte_classes([nfa])
    example = [classes.index(c) for c in range(max(classes) + 1)]
    number = {nfa.closure([start]): 0, frozenset(): 1}
    todo, steps = list(number), {}
    for states in todo:
        steps[number[states]] = row = []
        for byte in example:
            after = nfa.step(states, byte)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
    order = sorted(number, key=number.get)
    accepts = np.array([end in s for s in order], np.int64)
    small, accepts, place = minimised(np.array([steps[i] for i in range(len(order))]), accepts)
    return _arranged(small, accepts, classes, [place[0], place[1]])


def _joined(patterns: list[tuple[str, bool]]) -> tuple[Nfa, int, int]:
    nfa = Nfa()
    start = end = nfa.state()
    for text, fold in patterns:
        first, last = _Parser(nfa, text, fold).parse()
        nfa.empty[end].append(first)
        end = last
    return nfa, start, end


def _arranged(steps, accepts, classes, first) -> Dfa:
    """Transition array over all bytes with the states of ``first`` in front, accepting ones last."""
    rest = [s for s in np.argsort(accepts != 0, kind="stable") if s not in first]
    order = np.array([*first, *rest])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = place[steps[order]][:, classes].astype(np.int32)
    return Dfa(table.reshape(-1), accepts[order])


#: Where no match of a rule is under way; thread sets of a rule, earliest start first; whether the first has matched.
Search = tuple[tuple[frozenset[int], ...], bool]


def _advance(nfa: Nfa, start: frozenset[int], end: int, search: Search, byte: int) -> tuple[Search, bool]:
    """The rule's search after a byte, and whether a match ended just before it."""
    threads, matched = search
    ended = False
    after = [nfa.step(t, byte) for t in threads]
    if matched and not after[0]:
        after, matched, ended = [], False, True
    if not matched:
        after.append(nfa.step(start, byte))
        seen: set[int] = set()
        kept = []
        for states in after:
            states = frozenset(states - seen)
            seen |= states
            if states:
                kept.append(states)
            if end in states:
                break
        # An earlier start that lives on may still match, so only a first set's match is final.
        if kept and end in kept[0]:
            return ((kept[0],), True), ended
        if any(end in states for states in kept):
            raise ValueError("a later start matches while an earlier one is undecided")
        return (tuple(kept), False), ended
    if end not in after[0]:
        raise ValueError("a match must stay one until its last byte")
    return ((after[0],), True), ended


def scanner(rules: list[Rule]) -> Dfa:
    """One automaton for the searches of all rules; state 0 starts.

    Entering a state with bit i set in ``accepts`` says that a match of rule i ended just
    before the byte read last. Rules must be such that an accepted match can only end where
    its last byte is read (a closing repeated class, or a fixed end); others are refused.
    """
    parts = []
    for rule in rules:
        nfa, start, end = _joined([(rule.head, rule.ignore_case), (rule.body, False)])
        parts.append((nfa, nfa.closure([start]), end))
    classes = _byte_classes([nfa for nfa, _, _ in parts])
    example = [classes.index(c) for c in range(max(classes) + 1)]
    memo: list[dict] = [{} for _ in parts]
    begin = (tuple(((), False) for _ in parts), 0)
    number, todo, steps = {begin: 0}, [begin], []
    for searches, _ in todo:
        row = []
        for cls, byte in enumerate(example):
            after, ends = [], 0
            for i, (search, (nfa, start, end)) in enumerate(zip(searches, parts, strict=True)):
                if (search, cls) not in memo[i]:
                    memo[i][search, cls] = _advance(nfa, start, end, search, byte)
                moved, ended = memo[i][search, cls]
                after.append(moved)
                ends |= ended << i
            state = (tuple(after), ends)
            if state not in number:
                number[state] = len(number)
                todo.append(state)
            row.append(number[state])
        steps.append(row)
    accepts = np.array([ends for _, ends in todo], np.int64)
    small, accepts, place = minimised(np.array(steps), accepts)
    return _arranged(small, accepts, classes, [place[0]])
