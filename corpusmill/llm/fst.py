"""Finite-state rules over tokens: a small rule language, compiled to one automaton that is determinised as it is used.

A rule is a regular expression over tokens, which stand apart by blanks:

    word          the token with this label           {NAME}   a token with this label of the lexicon, or, where a part
    .             any token                                    of that name was defined, the part itself
    ~             any token but a negation            ( a | b )  ? * + {m,n}   as usual
    ^  $          begin and end of the clause         < ... >  what a rewriting rule replaces

The lexicon maps a token to the set of labels it carries (itself among them); tokens with the same set are one symbol, so
composing the lexicon with the rules means reading symbols instead of tokens. `Acceptor` runs all rules at once, one
transition per token, whatever their number. `Rewriter` replaces the marked tokens of a match by a neutral symbol.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

BEGIN, END, NEGATION = "^", "$", "NEG"
NEUTRAL = frozenset({"WORD", "FREE", "UNLIKE"})

#: States and transitions kept; beyond it the automaton forgets and determinises anew.
STATES = 60_000

_PIECE = re.compile(r"\{[A-Z_]+\}|\{\d+,\d*\}|[()|?*+<>]|[^\s(){}|?*+<>]+")

Node = tuple  # ("sym", label) ("seq", [..]) ("alt", [..]) ("rep", node, least, most or None) ("mark", node)


def parse(rule: str, parts: dict[str, Node] | None = None) -> Node:
    pieces, at = _PIECE.findall(rule), 0

    def alternatives(closing: str | None) -> Node:
        nonlocal at
        out, run = [], []
        while at < len(pieces):
            p = pieces[at]
            if p == closing:
                break
            at += 1
            if p == "|":
                out.append(("seq", run))
                run = []
            elif p in "?*+" or re.fullmatch(r"\{\d+,\d*\}", p):
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(p) or (int(p[1:].split(",")[0]), int(p[:-1].split(",")[1] or 0) or None)
                run[-1] = ("rep", run[-1], least, most)
            elif p in "(<":
                inner = alternatives(")" if p == "(" else ">")
                if at >= len(pieces):
                    raise ValueError(f"not closed: {rule}")
                at += 1
                run.append(inner if p == "(" else ("mark", inner))
            elif p in ")>":
                raise ValueError(f"not opened: {rule}")
            elif p[0] == "{":
                run.append((parts or {}).get(p[1:-1]) or ("sym", p[1:-1]))
            else:
                run.append(("sym", p))
        out.append(("seq", run))
        return out[0] if len(out) == 1 else ("alt", out)

    return alternatives(None)


def labels(node: Node) -> set[str]:
    """The labels that a rule asks for."""
    if node[0] == "sym":
        return {node[1]} - {".", "~"}
    inner = node[1] if node[0] in ("seq", "alt") else [node[1]]
    return set().union(*map(labels, inner)) if inner else set()


def fits(label: str, symbol: frozenset) -> bool:
    if label == ".":
        return BEGIN not in symbol and END not in symbol
    if label == "~":
        return BEGIN not in symbol and END not in symbol and NEGATION not in symbol
    return label in symbol


class Acceptor:
    """All rules as one automaton: `scan(symbols)` gives the numbers of the rules that match somewhere in the clause."""

    def __init__(self, rules: Iterable[Node]):
        self.moves: list[list[tuple[str, int]]] = []  # of a state of the automaton with choices: (label, state)
        self.empty: list[list[int]] = []
        self.final: dict[int, int] = {}
        self.root = self._state()
        for k, r in enumerate(rules):
            a = self._state()
            self.empty[self.root].append(a)
            self.final[self._build(r, a)] = k
        self._reset()

    def _state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _build(self, node: Node, a: int) -> int:
        kind = node[0]
        if kind == "sym":
            b = self._state()
            self.moves[a].append((node[1], b))
            return b
        if kind == "mark":
            return self._build(node[1], a)
        if kind == "seq":
            for x in node[1]:
                a = self._build(x, a)
            return a
        if kind == "alt":
            b = self._state()
            for x in node[1]:
                c = self._state()
                self.empty[a].append(c)
                self.empty[self._build(x, c)].append(b)
            return b
        _, x, least, most = node
        for _ in range(least):
            a = self._build(x, a)
        if most is None:
            loop = self._state()
            self.empty[a].append(loop)
            self.empty[self._build(x, loop)].append(loop)
            return loop
        end = self._state()
        self.empty[a].append(end)
        for _ in range(most - least):
            a = self._build(x, a)
            self.empty[a].append(end)
        return end

    def _closed(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for b in self.empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset[int]] = []
        self.next: list[dict[frozenset, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.start = self._closed([self.root])
        self._known(self.start)

    def _known(self, states: frozenset[int]) -> int:
        n = self.number.get(states)
        if n is None:
            n = self.number[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            self.accepts.append(tuple(sorted(self.final[s] for s in states if s in self.final)))
        return n

    def _step(self, state: int, symbol: frozenset) -> int:
        reached = {b for a in self.sets[state] for label, b in self.moves[a] if fits(label, symbol)}
        n = self._known(self._closed(reached) | self.start)
        self.next[state][symbol] = n
        return n

    def scan(self, symbols: Iterable[frozenset]) -> set[int]:
        if len(self.sets) > STATES:
            self._reset()
        found: set[int] = set()
        state, following, accepts = 0, self.next, self.accepts
        for s in symbols:
            n = following[state].get(s)
            state = self._step(state, s) if n is None else n
            if accepts[state]:
                found.update(accepts[state])
        return found

    def needs(self, rule: int, common: Callable[[str], bool]) -> bool:
        """Whether the rule cannot match without a label that is not common: then a text without such labels need not be
        read."""
        end = next(s for s, k in self.final.items() if k == rule)
        seen = todo = self._closed([self.root])
        while todo:
            step = {b for a in todo for label, b in self.moves[a] if label in ".~" or common(label)}
            todo = self._closed(step) - seen
            seen = seen | todo
        return end not in seen


class Rewriter:
    """Rules with a marked part; the marked tokens of every match become neutral, rule by rule, from left to right."""

    def __init__(self, rules: Iterable[Node]):
        self.rules = [(r, _first(r)[0]) for r in rules]

    def __call__(self, symbols: list[frozenset]) -> list[frozenset]:
        s = list(symbols)
        for rule, first in self.rules:
            i = 0
            while i < len(s):
                got = None if first.isdisjoint(s[i]) else next(_matches(rule, s, i, ()), None)
                if got is None:
                    i += 1
                    continue
                for a, b in got[1]:
                    s[a:b] = [x if x & {BEGIN, END, ","} else NEUTRAL for x in s[a:b]]
                i = max(i + 1, got[1][-1][1] if got[1] else got[0])
        return s


def _first(node: Node) -> tuple[set[str], bool]:
    """(labels with which a match can begin, whether it can be empty)"""
    kind = node[0]
    if kind == "sym":
        return {node[1]} if node[1] not in ".~" else {"WORD", ","}, False
    if kind == "seq":
        out: set[str] = set()
        for x in node[1]:
            got, empty = _first(x)
            out |= got
            if not empty:
                return out, False
        return out, True
    if kind == "alt":
        each = [_first(x) for x in node[1]]
        return set().union(*(g for g, _ in each)), any(e for _, e in each)
    got, empty = _first(node[1])
    return got, empty or kind == "rep" and node[2] == 0


def _matches(node: Node, s: list[frozenset], i: int, marks: tuple):
    """(end, marked spans) of the matches of a node at i; longer repetitions first."""
    kind = node[0]
    if kind == "sym":
        if i < len(s) and fits(node[1], s[i]):
            yield i + 1, marks
    elif kind == "seq":
        yield from _sequence(node[1], 0, s, i, marks)
    elif kind == "alt":
        for x in node[1]:
            yield from _matches(x, s, i, marks)
    elif kind == "mark":
        for j, m in _matches(node[1], s, i, marks):
            yield j, (*m, (i, j))
    else:
        yield from _repeated(node, 0, s, i, marks)


def _sequence(nodes: list, k: int, s, i: int, marks: tuple):
    if k == len(nodes):
        yield i, marks
        return
    for j, m in _matches(nodes[k], s, i, marks):
        yield from _sequence(nodes, k + 1, s, j, m)


def _repeated(node: Node, n: int, s, i: int, marks: tuple):
    """Most repetitions first, with a stack instead of recursion over them."""
    _, x, least, most = node
    stack, ends = [(i, marks, n)], []
    while stack:  # one way through each repetition; the parts repeated are single tokens or short
        at, m, count = stack.pop()
        ends.append((at, m, count))
        if most is None or count < most:
            for j, mm in _matches(x, s, at, m):
                if j > at:
                    stack.append((j, mm, count + 1))
                    break
    for at, m, count in reversed(ends):
        if count >= least:
            yield at, m
