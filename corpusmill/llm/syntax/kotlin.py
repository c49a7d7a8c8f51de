"""Kotlin."""

from __future__ import annotations

import re

from .core import ANY_BRACE, ANY_LIST, ANY_PAREN, Grammar, rx, settle, statements

_STRING = r'"(?:[^"\\\n\r$]|\\.|\$(?!\{)|\$\{(?:[^{}"]|"(?:[^"\\\n]|\\.)*"|\{[^{}]*\})*\})*"'
_TOKEN = re.compile(
    rf"""(?:[ \t\f﻿]+|//[^\n\r]*|\A\#![^\n]*)*(?:
    (?P<n>[\r\n;]\s*)
    |(?P<c>/\*)
    |(?P<i>[A-Za-z_ª-퟿]\w*|`[^`\n]+`)
    |(?P<d>0[xX][\da-fA-F_]+[uUL]*|0[bB][01_]+[uUL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[uULfF]*|\.\d[\d_]*(?:[eE][+-]?\d+)?[fF]?)
    |(?P<q>\"\"\"(?:[^"]|"(?!""))*\"\"\"+|{_STRING}|'(?:[^'\\\n]|\\(?:u[\da-fA-F]{{4}}|.))')
    |(?P<p>===|!==|\.\.<|\.\.|->|::|\?\.|\?:|!!|==|!=|<=|>=|&&|\|\||\+\+|--|!in\b|!is\b|as\?|[-+*/%]=|[(){{}}\[\],<>=.?:!@*/%&|+-])
    |(?P<x>\S)|\Z)""",
    re.X,
)
# m modifiers, c class-like, f fun, v val/var, K package, M import, t typealias, j in/is/as, I E F W D S R B T Y C N statements, n init, b by, o constructor
_WORDS = {
    **dict.fromkeys(
        "public private protected internal open abstract final override lateinit sealed inline suspend operator infix const external annotation companion inner tailrec vararg noinline crossinline reified expect actual data value enum".split(), "m"
    ),
    "class": "c", "interface": "c", "object": "c", "fun": "f", "val": "v", "var": "v", "package": "K", "import": "M", "typealias": "t", "in": "j", "is": "j", "as": "j", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D",
    "when": "S", "return": "R", "throw": "T", "break": "B", "continue": "B", "try": "Y", "catch": "C", "finally": "N", "init": "n", "by": "b", "constructor": "o", "where": "w", "true": "p", "false": "p", "null": "p", "this": "p",
    "super": "p",
}
_OPS = {"->": "→", "::": ".", "?.": ".", "?:": "%", "!!": "#", "++": "#", "--": "#", "+": "+", "-": "+", "!in": "j", "!is": "j", "as?": "j", "..": "%", "..<": "%"}
_PLAIN = re.compile(r"(?<=\.)[A-Za-z]|m(?![\wφ@])|n(?!\{)|b(?![\w(])|(?<![)iG>])b|w(?!i)|o(?!\()")
_JOIN = re.compile(r"(?<=[,=%*|<.:+!→(\[jTbK&])\n|\n(?=[,=%*|.?:→)\]E&])|(?<=[)i}])\n(?=[CN])")


class Kotlin(Grammar):
    name = "kotlin"
    roles = {"(": ["args", "params", "for"], "[": ["list"], "{": ["block", "when"]}

    def lex(self, text):
        out, at = [], 0
        get, put, n = _WORDS.get, out.append, len(text)
        if "/*" in text:
            text = _strip_comments(text)
            if text is None:
                return None
        for m in _TOKEN.finditer(text):
            k = m.lastgroup
            if k == "i":
                put(get(m.group("i"), "i"))
            elif k == "p":
                p = m.group("p")
                put(_OPS.get(p) or ("=" if len(p) == 2 and p[1] == "=" and p[0] in "-+*/%" else "%" if len(p) > 1 or p in "/%" else p))
            elif k == "n":
                if out and out[-1] != "\n":
                    put("\n")
            elif k == "d":
                put("0")
            elif k == "q":
                put("s")
            elif k in ("x", "c"):
                return None
        return _JOIN.sub("", _PLAIN.sub("i", re.sub(r"\.\*(?=\n|\Z)", "", "".join(out))))

    def build(self):
        R = self.role
        args, params, block, when = R("(", "args"), R("(", "params"), R("{", "block"), R("{", "when")
        paren = R("(", "args", "params")
        self.first = [(rx(f"@(?:i:)?i(?:\\.i)*+(?:{ANY_PAREN})?\n?"), ""), (rx(r"[RBp]@i"), lambda m: m.group()[0]), (rx(r"i@"), "")]
        self.generic = [(rx(f"(?<=[if.])<(?:[i.,?*:jmG→\n]|{ANY_PAREN})*+>"), "G")]
        self.heads = [
            (rx(f"I{args}\n?"), "ι"), (rx(f"W{args}"), "ω"), (rx(f"F{R('(', 'for')}\n?"), "ƒ"), (rx(f"S(?:{args}|{params})?\n?{when}"), "φ"), (rx(f"Y{block}(?:\n?C{params}{block})*+(?:\n?N{block})?"), "φ"),
            (rx(f"f(?:i\\.)?{paren}(?::i)?{block}"), "φ"), (rx(f"c(?::[^\n{{}}]*?)?{block}(?=[),\n]|\\Z)"), "φ"),
        ]
        atom = f"(?:[ips0φ]|{paren}|{ANY_LIST}|{block}|R(?=[\n)]|\\Z))"
        post = f"(?:\\.[ip]|\\.c|[#?G]|{paren}|{ANY_LIST}|{block})*+"
        unit = f"(?:[+!#jTιR*]|{paren}→|m(?=i))*+{atom}{post}"
        op = r"(?:[+*%<>|=jE&]|\n?E|i(?=[ips0φ(-+]))"
        self.chain = rx(f"(?<!\\.){unit}(?:{op}{unit})*+")
        self.rules = [(rx(r"ε[+*%<>|=jE&]ε"), "ε"), (rx(f"{paren}→ε"), "ε")]
        self.args = rx(r"(?:\*?ε(?:,\*?ε)*+,?)?")
        self.params = rx(r"(?:m*+v?ε(?::ε)?(?:,m*+v?ε(?::ε)?)*+,?)?")
        self.forhead = rx(r"ε(?::ε)?(?:jε)?")
        end = r"(?:\n|\Z)"
        sup = r"(?:\n?:\n?ε(?:b?ε)?(?:,\n?ε(?:bε)?)*+)?"
        self.head = rx(r"(?:ι|ƒ|ω\n?)*+")
        self.stmt = rx(
            f"\n|m*+c(?:ε)?{sup}{end}|m*+fG?ε(?::ε)?{end}|m*+v(?:G)?ε(?::ε)?(?:bε)?{end}|tε{end}|n{block}{end}|m*+o{paren}(?::ε)?(?:{block})?{end}|m*+c{block}{end}|Bε?{end}|D\n?{block}\n?ω{end}|D{block}ω{end}|m++ε{end}|ε{end}"
        )
        self.lambda_ = rx(r"\A(?:ε(?::ε)?(?:,ε(?::ε)?)*+)?→")
        self.entries = rx(r"\A\n?ε(?:,\n?ε)*+,?\n?(?=\n|\Z)")
        self.branch = rx(f"\n|(?:ε(?:,\n?ε)*+|E)→(?:{block}|ε|Bε?){end}|(?:ε|E){end}")
        self.file = rx(r"\n?(?:Kε(?:\n|\Z))?(?:\n|Mε(?:%?ε|\.\*)?(?:\n|\Z))*+")

    def expr(self, s: str) -> str:
        for p, to in self.first:
            s = p.sub(to, s)
        while "<" in s:
            t = self.generic[0][0].sub("G", s)
            if t == s:
                break
            s = t
        for p, to in self.heads:
            s = p.sub(to, s)
        return settle(self.chain.sub("ε", s), self.rules)

    def has(self, bracket, role, s):
        if bracket == "(":
            e = self.expr(s.replace("\n", ""))
            return bool({"args": self.args, "params": self.params, "for": self.forhead}[role].fullmatch(e)) or role == "for" and bool(re.fullmatch("ε(?::ε)?jε|ε", e))
        if bracket == "[":
            return bool(self.args.fullmatch(self.expr(s.replace("\n", ""))))
        if role == "when":
            e = self.expr(re.sub(r"(?<=[,\n])j|\Aj", "", re.sub(r"\n?E(?=→)", "\n0", s)))
            at = 0
            while at < len(e):
                m = self.branch.match(e, at)
                if not m or m.end() == at:
                    return False
                at = m.end()
            return "→" in s
        e = self.expr(s)
        e = self.lambda_.sub("", e, count=1)
        if "," in e:
            e = self.entries.sub("", e, count=1)
        return statements(e, self.head, self.stmt)

    def top(self, s):
        e = self.expr(s)
        m = self.file.match(e)
        rest = e[m.end() :]
        return not re.search(r"(?:\A|\n)ε(?:\n|\Z)", rest) and statements(rest, self.head, self.stmt)


def _strip_comments(text: str) -> str | None:
    """Block comments nest; strings before them are passed over. A comment with a line end leaves one."""
    out, at, depth, start = [], 0, 0, 0
    for m in re.finditer(rf"/\*|\*/|\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"+|{_STRING}|'(?:[^'\\\n]|\\.)*'|//[^\n]*", text):
        g = m.group()
        if depth:
            # inside a comment only its marks count, also where they stand in what looks like a string
            for k in re.finditer(r"/\*|\*/", g):
                depth += 1 if k.group() == "/*" else -1
                if not depth:
                    at = m.start() + k.end()
                    break
            if not depth:
                out.append("\n" if "\n" in text[start:at] else " ")
        elif g == "/*":
            out.append(text[at : m.start()])
            depth, start = 1, m.start()
        elif g == "*/":
            return None
    if depth:
        return None
    out.append(text[at:])
    return "".join(out)
