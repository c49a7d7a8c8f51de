"""Grammars over bracket trees.

A source is lexed into a string with one character per token. Brackets are then reduced from the inside: the content of
a bracket is a flat string in which the brackets inside it are single characters. Expressions in it are reduced to one
character, as a bottom-up parser does, and what is left - statements, members, parameters - is checked by regular
expressions that stand for the rules of the grammar. A bracket becomes a character that tells in which roles its
content is valid, and the rules around it ask for a role. The verdict on a content depends on its string alone and is
kept in a bounded cache; since names and literals are classes, most contents of a corpus have been seen before.
"""

from __future__ import annotations

import re

_BRACKET = re.compile(r"[()\[\]{}]")
_OPEN = {")": "(", "]": "[", "}": "{"}
_BASE = {"(": 0xE000, "[": 0xE200, "{": 0xE400}
#: Verdicts kept per grammar and worker.
CACHE = 300_000

ANY_PAREN, ANY_LIST, ANY_BRACE = "[\ue000-\ue1ff]", "[\ue200-\ue3ff]", "[\ue400-\ue5ff]"


def rx(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)


class Grammar:
    """`roles` names the roles of each bracket; `has(bracket, role, content)` checks one; `top` the whole."""

    name = ""
    roles: dict[str, list[str]] = {"(": [], "[": [], "{": []}

    def __init__(self):
        self.memo: dict[str, str | None] = {}
        self.build()

    def build(self) -> None:
        """Compile the rules."""

    def lex(self, text: str) -> str | None:
        """Token classes, or None where the text cannot be cut into tokens."""
        raise NotImplementedError

    def has(self, bracket: str, role: str, s: str) -> bool:
        raise NotImplementedError

    def top(self, s: str) -> bool:
        raise NotImplementedError

    @classmethod
    def role(cls, bracket: str, *names: str) -> str:
        """Character class of the reduced brackets whose content is valid in one of the roles."""
        ks = [cls.roles[bracket].index(n) for n in names]
        codes = [c for c in range(1, 1 << len(cls.roles[bracket])) if any(c >> k & 1 for k in ks)]
        return "[" + "".join(chr(_BASE[bracket] + c) for c in codes) + "]"

    def reduce(self, s: str) -> str | None:
        parts, opened, at, memo = [[]], [], 0, self.memo
        for m in _BRACKET.finditer(s):
            p = m.start()
            c = s[p]
            parts[-1].append(s[at:p])
            at = p + 1
            if c in "([{":
                opened.append(c)
                parts.append([])
                continue
            if not opened or opened.pop() != _OPEN[c]:
                return None
            key = c + "".join(parts.pop())
            got = memo.get(key, 0)
            if got == 0:
                got = self._classify(_OPEN[c], key[1:])
                if len(memo) >= CACHE:
                    memo.clear()
                memo[key] = got
            if got is None:
                return None
            parts[-1].append(got)
        if opened:
            return None
        parts[0].append(s[at:])
        return "".join(parts[0])

    def _classify(self, bracket: str, content: str) -> str | None:
        code = 0
        for k, role in enumerate(self.roles[bracket]):
            if self.has(bracket, role, content):
                code |= 1 << k
        return chr(_BASE[bracket] + code) if code else None

    def valid(self, text: str) -> bool:
        s = self.lex(text)
        if s is None:
            return False
        flat = self.reduce(s)
        if flat is None:
            return False
        key = "T" + flat
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = "y" if self.top(flat) else "n"
        return got == "y"


def sequence(item: re.Pattern, s: str) -> bool:
    """Whether `s` is a sequence of items, each of which takes up something."""
    at, n, match = 0, len(s), item.match
    while at < n:
        m = match(s, at)
        if m is None or m.end() == at:
            return False
        at = m.end()
    return True


def settle(s: str, rules: list[tuple[re.Pattern, str]]) -> str:
    """Apply the reductions in turn until none changes the string; every reduction shortens it."""
    while True:
        before = s
        for p, to in rules:
            s = p.sub(to, s)
        if s == before:
            return s


def statements(s: str, head: re.Pattern, stmt: re.Pattern, case: re.Pattern | None = None, first_case: bool = False) -> bool:
    """A sequence of statements in which heads (`if`, loops, labels) stand before a statement, and `E` (else) needs an
    open `if` (`ι` in a head) before it. `case` labels begin groups of a switch."""
    at, n, ifs, waiting = 0, len(s), 0, first_case
    while at < n:
        c = s[at]
        if c == "\n":
            at += 1
            continue
        if case is not None and (m := case.match(s, at)):
            at, ifs, waiting = m.end(), 0, False
            continue
        if waiting:
            return False
        if c == "E":
            if not ifs:
                return False
            at, ifs = at + 1, ifs - 1
            while at < n and s[at] == "\n":
                at += 1
        else:
            ifs = 0
        m = head.match(s, at)
        took = s.count("ι", at, m.end())
        if m.end() > at and m.end() >= n:
            return False
        at = m.end()
        m = stmt.match(s, at)
        if not m or m.end() == at:
            return False
        ifs += took
        at = m.end()
    return True
