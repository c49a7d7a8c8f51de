"""Go."""

from __future__ import annotations

import re

from .core import ANY_BRACE, ANY_LIST, ANY_PAREN, Grammar, rx, sequence, settle

_TOKEN = re.compile(
    r"""(?:[ \t\r\f﻿]+|//[^\n]*)*(?:
    (?P<n>\n\s*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<i>[A-Za-z_ª-퟿]\w*)
    |(?P<d>0[xXbBoO][\da-fA-F_.]+(?:[pP][+-]?\d+)?i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)
    |(?P<q>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))')
    |(?P<p>\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|>>=|&\^=|&\^|<<|>>|[-+*/%&|^]=|[(){}\[\];,<>=.:!~*/%&|^+-])
    |(?P<x>\S)|\Z)""",
    re.X,
)
# K package, M import, f func, t type, c struct/interface, v var/const, m map, q chan, I E F S L statements, r range, k case, d default, R return, y go/defer, B break
_WORDS = {
    "package": "K", "import": "M", "func": "f", "type": "t", "struct": "c", "interface": "h", "var": "v", "const": "v", "map": "m", "chan": "q", "if": "I", "else": "E", "for": "F", "switch": "S", "select": "S", "range": "r", "case": "k",
    "default": "d", "return": "R", "go": "y", "defer": "y", "break": "B", "continue": "B", "goto": "B", "fallthrough": "B",
}
_OPS = {"...": "^", "++": "#", "--": "#", "+": "+", "-": "+", "^": "+", "&": "*", "!": "!", "~": "!", "<-": "<", ":=": "="}


class Go(Grammar):
    name = "go"
    roles = {"(": ["args", "params", "decls"], "[": ["list", "params"], "{": ["block", "list", "switch", "fields"]}

    def lex(self, text):
        out = []
        get, put = _WORDS.get, out.append
        for m in _TOKEN.finditer(text):
            k = m.lastgroup
            if k == "i":
                put(get(m.group("i"), "i"))
            elif k == "p":
                p = m.group("p")
                put(_OPS.get(p) or ("=" if p[-1] == "=" and p not in ("==", "!=", "<=", ">=") else "%" if len(p) > 1 or p in "/%|<>" else p))
            elif k == "n":
                if out and out[-1] in "i0s)]}RB#" and "\n" in m.group("n"):
                    put(";")
            elif k == "d":
                put("0")
            elif k == "q":
                put("s")
            elif k == "x":
                return None
        return re.sub(r"(?<=\.)[a-zA-Z]", "i", "".join(out))

    def build(self):
        R = self.role
        args, params, decls = R("(", "args"), R("(", "params"), R("(", "decls")
        paren = R("(", "args", "params")
        block, lists, switch, fields = R("{", "block"), R("{", "list"), R("{", "switch"), R("{", "fields")
        pre = f"(?:\\*|{ANY_LIST}|m{ANY_LIST}|q<?|<q|\\^)*+"
        typ = f"{pre}(?:i(?:\\.i)?(?:{ANY_LIST})?|[ch]{fields}|f{paren}(?:{paren}|{pre}i(?:\\.i)?)?|{args})"
        self.funcs = [(rx(f"f{paren}(?:{paren}|{typ})?{block}"), "φ"), (rx(f"f{paren}(?:{paren}|{typ})?"), "φ"), (rx(f"[ch]{fields}"), "i")]
        self.func = rx(f"f(?:{params}|{args})?i(?:{ANY_LIST})?{paren}(?:{paren}|{typ})?(?:{block})?(?=;|\\Z)")
        self.flow = rx(f"([IFS])([^\\ue400-\\ue5ffIFSE]*){ANY_BRACE}(?=[;E]|\\Z)")
        self.block, self.switch = rx(block), rx(switch)
        operand = f"(?:[i0sφε]|{paren})"
        post = f"(?:\\.(?:i|{args})|{paren}|{ANY_LIST}|\\^(?=[,;]|\\Z))*+"
        unit = f"(?:[+*!<]|{ANY_LIST}|m{ANY_LIST}|q)*+{operand}{post}"
        op = r"(?:[+*%<])"
        lit = f"(?:{lists}{post})*+"
        self.chain = rx(f"(?<!\\.){unit}{lit}(?:{op}{unit}{lit})*+")
        self.plain = rx(f"(?<!\\.){unit}(?:{op}{unit})*+")
        self.rules = [(rx(f"ε{op}ε"), "ε")]
        self.args = rx(r"(?:ε(?:,ε)*+,?)?")
        el = f"(?:ε|{lists})"
        self.list = rx(f"(?:{el}(?::{el})?(?:,{el}(?::{el})?)*+,?)?")
        p = r"ε?\^?ε"
        self.params = rx(f"(?:{p}(?:,{p})*+,?)?")
        simple = r"(?:ε(?:,ε)*+(?:=r?ε(?:,ε)*+|#|<ε)?)"
        self.ifhead = rx(f"(?:{simple}?;)?ε")
        self.forhead = rx(f"|ε|r?ε|{simple}|{simple}?;ε?;{simple}?")
        self.switchhead = rx(f"(?:{simple}?;)?(?:{simple})?")
        var = f"vε(?:,ε)*+ε?(?:=ε(?:,ε)*+)?|v{decls}"
        types = f"tεε|tε=ε|t{decls}"
        self.stmt = rx(f";|(?:β(?:Eβ)*+(?:E{block})?|{var}|{types}|R(?:ε(?:,ε)*+)?|yε|Bε?|{simple}|{block})(?:;|\\Z)|ε:;?")
        self.case = rx(r"k(?:ε(?:,ε)*+(?:=ε|<ε)?):|d:")
        self.decl = rx(f"Δ(?:;|\\Z)|(?:{var}|{types})(?:;|\\Z)|;")
        self.field = rx(r"(?:ε(?:,ε)*+ε{0,2}|\*?ε|ε(?:%ε)*+|Δ)(?:;|\Z)")
        self.group = rx(r"(?:;|ε(?:,ε)*+ε?(?:=ε(?:,ε)*+)?(?:;|\Z))")
        self.file = rx(f"Ki(?:;|\\Z)(?:;|M(?:i|\\.)?s(?:;|\\Z)|M{R('(', 'decls', 'args')}(?:;|\\Z))*+")

    def flows(self, s: str) -> str:
        """Statements with a header as β, from the right, so that what stands in a header is not taken for a body."""

        def one(m):
            kind, head, body = m.group(1), self.expr(m.group(2), False), m.group()[-1]
            if kind == "I":
                ok = self.ifhead.fullmatch(head) and self.block.match(body)
            elif kind == "F":
                ok = self.forhead.fullmatch(head) and self.block.match(body)
            else:
                ok = self.switchhead.fullmatch(head) and self.switch.match(body)
            return "β" if ok else "!!"

        return self.flow.sub(one, s)

    def expr(self, s: str, literals: bool = True) -> str:
        for p, to in self.funcs:
            s = p.sub(to, s)
        s = (self.chain if literals else self.plain).sub("ε", s)
        return settle(s, self.rules)

    def body(self, s: str) -> str:
        s = self.funcs[0][0].sub("φ", s)
        return self.expr(self.flows(s))

    def has(self, bracket, role, s):
        if bracket == "(":
            if role == "decls":
                return sequence(self.group, re.sub(r"(?:^|(?<=;))(?:i|\.)?s(?=;|$)", "ε", s) if "s" in s and re.fullmatch(r"(?:(?:i|\.)?s;|;)*(?:i|\.)?s?", s) else self.expr(s))
            e = self.expr(s.replace(";", "") if s.endswith(";") else s)
            return bool((self.args if role == "args" else self.params).fullmatch(e))
        if bracket == "[":
            e = self.expr(s)
            return bool(re.fullmatch(r"ε?(?::ε?){0,2}|\^|(?:ε(?:,ε)*+)?", e)) if role == "list" else bool(self.params.fullmatch(e))
        if role == "list":
            return bool(self.list.fullmatch(self.expr(s[:-1] if s.endswith(";") else s)))
        if role == "fields":
            return sequence(self.field, self.expr(s))
        e = self.body(s)
        if role == "block":
            return sequence(self.stmt, e)
        at = 0
        while at < len(e):
            m = self.case.match(e, at) or (self.stmt.match(e, at) if at else None)
            if not m or m.end() == at:
                return False
            at = m.end()
        return True

    def top(self, s):
        m = self.file.match(s)
        if not m:
            return not s.strip(";")
        rest = self.func.sub("Δ", s[m.end() :])
        return sequence(self.decl, self.expr(rest))
