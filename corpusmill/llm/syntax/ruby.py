"""Ruby."""

from __future__ import annotations

import re

from .core import Grammar, rx, sequence, settle

_STRING = r'"(?:[^"\\#]|\\[\s\S]|\#(?!\{)|\#\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\})*"'
_TOKEN = re.compile(
    r"""(?:[ \t\f\r]+|\#[^\n]*|\\\r?\n|(?:(?<=\n)|\A)=begin\b[\s\S]*?\n=end[^\n]*)*(?:
    (?P<n>[\n;]\s*)
    |(?P<q>STRING|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\|[^|]*\||![^!]*!)|:"(?:[^"\\]|\\.)*"|(?<![:\w)\]]):(?:[A-Za-z_]\w*[?!=]?|[-+*/<>=!~%&|^]+|\[\]=?)|(?<=[\s(,\[])\?[A-Za-z](?!\w))
    |(?P<l>[A-Za-z_]\w*[?!]?:(?!:)(?=[\s\[({"'\w:]))
    |(?P<i>(?:@@?|\$)?[A-Za-z_ª-퟿]\w*[?!]?|\$[\d~!@&`'+*$?:"<>,./\;])
    |(?P<d>0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?)
    |(?P<r>(?:(?<=[=(,\[!&|?{};~\n])|(?<=[=(,\[!&|?{};~][ ])|(?<=when[ ])|(?<=if[ ])|(?<=and[ ])|(?<=split[ ]))/(?:[^/\\\n]|\\.)+/[a-z]*)
    |(?P<p>\*\*=|\|\|=|&&=|<=>|===|\.\.\.|<<=|>>=|\*\*|==|!=|<=|>=|=~|!~|=>|->|&&|\|\||<<|>>|::|&\.|\.\.|[-+*/%&|^]=|[(){}\[\],<>=.?:!~*/%&|^+-])
    |(?P<x>\S)|\Z)""".replace("STRING", _STRING),
    re.X,
)
# D def, C class/module, B begin, K case, I if/unless, W while/until, F for, d do, e end, t then, E else/ensure, R elsif/when/rescue, r return and the like, o and/or, n not, j in
_WORDS = {
    "def": "D", "class": "C", "module": "C", "begin": "B", "case": "K", "if": "I", "unless": "I", "while": "W", "until": "W", "for": "F", "do": "d", "end": "e", "then": "t", "else": "E", "ensure": "E", "elsif": "R", "when": "R", "rescue": "R",
    "return": "r", "break": "r", "next": "r", "redo": "r", "retry": "r", "and": "o", "or": "o", "not": "!", "in": "j", "alias": "a", "undef": "a",
}
_OPS = {"->": "→", "::": ".", "&.": ".", "+": "+", "-": "+", "!": "!", "~": "!", "...": "%", "..": "%", "**": "*", "&": "*", "*": "*"}
_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([A-Z_]\w*)\2(?![\w])")
_ENDLESS = re.compile(r"\bdef(?=\s+[\w.?!]+(?:\([^()\n]*\))?\s*=\s)")
_JOIN = re.compile(r"(?<=[,=%*<>+!→(\[{o:?&.|])\n(?!\|)|\n(?=[.)\]}])")


class Ruby(Grammar):
    name = "ruby"
    roles = {"(": ["args"], "[": ["list"], "{": ["word", "do", "block", "hash"]}

    def lex(self, text):
        text = text.split("\n__END__\n", 1)[0]
        if "<<" in text:
            text = _heredocs(text)
            if text is None:
                return None
        if "def" in text and _ENDLESS.search(text):
            text = _ENDLESS.sub("", text)
        out, stack = [], []
        put = out.append
        for m in _TOKEN.finditer(text):
            k = m.lastgroup
            if k == "i":
                w = m.group("i")
                c = _WORDS.get(w, "i") if not out or out[-1] != "." else "i"
                if c in "IWR" and out and (out[-1] in "i0s)]}r" or c == "R" and w == "rescue" and out[-1] not in "\n"):
                    if c == "R" and w != "rescue":
                        put(c)
                    else:
                        put("m")
                elif c in "DCBKIWF":
                    put("{")
                    put(c)
                    stack.append("W" if c in "WF" else "e")
                elif c == "d":
                    if stack and stack[-1] == "W":
                        stack[-1] = "e"
                        put("\n")
                    else:
                        put("{")
                        put("d")
                        stack.append("e")
                elif c == "e":
                    if not stack or stack.pop() not in "eW":
                        return None
                    put("}")
                elif c == "t":
                    put("\n")
                else:
                    put(c)
            elif k == "p":
                p = m.group("p")
                if p in "([{":
                    stack.append(p)
                    put(p)
                elif p in ")]}":
                    if not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[p]:
                        return None
                    put(p)
                else:
                    put(_OPS.get(p) or ("=" if p[-1] == "=" and p not in ("==", "!=", "<=", ">=", "===") else "%" if len(p) > 1 or p in "/%^" else p))
            elif k == "n":
                if stack and stack[-1] == "W":
                    stack[-1] = "e"
                if out and out[-1] != "\n":
                    put("\n")
            elif k == "l":
                put("l")
            elif k == "d":
                put("0")
            elif k in ("q", "r"):
                if not out or out[-1] != "s":
                    put("s")
            elif k == "x":
                return None
        return None if stack else _JOIN.sub("", "".join(out))

    def build(self):
        R = self.role
        args, lists = R("(", "args"), R("[", "list")
        word, do, block, hash_ = (R("{", x) for x in ("word", "do", "block", "hash"))
        atom = f"(?:[i0sε]|{args}|{lists}|{word}|(?<![i)s\\]-]){hash_}|→(?:{args}|i(?:,i)*+)?(?:{block}|{do}))"
        post = f"(?:\\.(?:i|{args})|{args}|{lists}|{block}|{do})*+"
        unit = f"(?:[!+*l]|a)*+{atom}{post}"
        op = r"(?:[+*%<>=|o]|j(?=[i0s(\[])|=!)"
        self.chain = rx(f"(?<!\\.){unit}(?:{op}{unit})*+|l(?=[,\n)]|\\Z)")
        self.leading = rx(f"\\A{hash_}")
        self.rules = [(rx(r"ε\?ε:ε"), "ε"), (rx(r"ε[+*%<>=|o]ε"), "ε"), (rx(r"ε\?εε(?=[,\n)]|\Z)"), "ε")]
        one = r"ε(?:ε(?:ε)?)?"
        self.list = rx(rf"(?:{one}(?:,{one})*+,?)?")
        end = r"(?:\n|\Z)"
        tail = r"(?:mε)*+"
        self.stmt = rx(rf"\n|r?{one}(?:,ε)*+{tail}(?:{do})?{end}|r{tail}{end}|(?:E|R){end}|Eε{end}|R(?:{one}(?:,ε)*+)?{end}|aε{end}|jε(?:,ε)*+{end}|R=ε{end}")
        self.open = {
            "D": rx(rf"D(?:ε(?:ε)?(?:,ε)*+|[+*%<>=|!\[\]]+{args}?|[!+*%<>=]+(?:ε)?|{lists}[=]?(?:ε)?){end}"), "C": rx(rf"C(?:ε|<ε|%ε){end}"), "B": rx(r"B"), "K": rx(rf"K(?:ε)?{end}"), "I": rx(rf"I{one}(?:,ε)*+{end}"), "W": rx(rf"W{one}{end}"),
            "F": rx(rf"Fε(?:,ε)*+(?:jε)?{end}"), "d": rx(r"d(?:\|[^|\n]*\|)?\n?"),
        }
        self.params = rx(r"\A\|[^|\n]*\|")

    def expr(self, s: str) -> str:
        return settle(self.chain.sub("ε", s), self.rules)

    def has(self, bracket, role, s):
        if bracket == "(":
            e = self.expr(self.leading.sub("i", s))
            return bool(self.list.fullmatch(e.replace("\n", ""))) or sequence(self.stmt, e)
        if bracket == "[":
            return bool(self.list.fullmatch(self.expr(self.leading.sub("i", s)).replace("\n", "")))
        kind = s[:1]
        if kind in self.open:
            if role != ("do" if kind == "d" else "word"):
                return False
            if kind == "d":
                m = self.open["d"].match(s)
                return sequence(self.stmt, self.expr(s[m.end() :]))
            e = self.expr(s[1:])
            m = self.open[kind].match(kind + e)
            return m is not None and sequence(self.stmt, (kind + e)[m.end() :])
        if role == "hash":
            return bool(self.list.fullmatch(self.expr(s.replace("\n", ""))))
        return role == "block" and sequence(self.stmt, self.expr(self.params.sub("", s).lstrip("\n")))

    def top(self, s):
        return sequence(self.stmt, self.expr(s)) and not re.match("[RE]", s)


def _heredocs(text: str) -> str | None:
    """The bodies of here-documents cut out; None where one has no end."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        out.append(line)
        i += 1
        if "<<" in line and not line.lstrip().startswith("#"):
            for m in _HEREDOC.finditer(line):
                if not m.group(1) and not m.group(2) and not re.search(r"[=(,]\s*$|\w\s+$", line[: m.start()]):
                    continue
                while i < len(lines) and lines[i].strip() != m.group(3):
                    i += 1
                if i >= len(lines):
                    return None
                i += 1
    return re.sub(_HEREDOC, '""', "\n".join(out)) if len(out) != len(lines) else "\n".join(out)
