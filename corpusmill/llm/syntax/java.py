"""Java."""

from __future__ import annotations

import re

from .core import ANY_BRACE, ANY_LIST, ANY_PAREN, Grammar, rx, sequence, settle, statements

_TOKEN = re.compile(
    r"""(?:\s+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)*(?:
    (?P<i>[A-Za-z_$ª-퟿][\w$]*)
    |(?P<d>0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)
    |(?P<q>\"\"\"[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))')
    |(?P<p>\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<=|>>>=|>>=|[-+*/%&|^]=|[(){}\[\];,<>=.?:!~@*/%&|^+-])
    |(?P<x>\S)|\Z)""",
    re.X,
)
# m modifiers, c class/interface/enum/record, K package, M import, x extends and the like, w new, j instanceof, I E F W D R B T Y C N S k d statements
_WORDS = {
    **dict.fromkeys("public private protected static final abstract native synchronized transient volatile strictfp".split(), "m"), "class": "c", "interface": "c", "enum": "e", "package": "K", "import": "M", "extends": "x",
    "implements": "x", "throws": "x", "new": "w", "instanceof": "j", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", "return": "R", "break": "B", "continue": "B", "throw": "T", "try": "Y", "catch": "C", "finally": "N",
    "switch": "S", "case": "k", "default": "d", "assert": "R", "goto": "?", "const": "?", "true": "p", "false": "p", "null": "p", "this": "p", "super": "p",
}
_OPS = {"->": "→", "::": ".", "...": "^", "++": "#", "--": "#", "+": "+", "-": "+", "!": "!", "~": "!"}
_SOFT = re.compile(r"(?<=\.)[wc]")


class Java(Grammar):
    name = "java"
    roles = {"(": ["args", "params", "for", "resources"], "[": ["list"], "{": ["block", "members", "list", "switch", "enum"]}

    def lex(self, text):
        out = []
        get, put = _WORDS.get, out.append
        for m in _TOKEN.finditer(text):
            k = m.lastgroup
            if k == "i":
                put(get(m.group("i"), "i"))
            elif k == "p":
                p = m.group("p")
                put(_OPS.get(p) or ("=" if p[-1] == "=" and p not in ("==", "!=", "<=", ">=") else "%" if len(p) > 1 or p in "/%^" else p))
            elif k == "d":
                put("0")
            elif k == "q":
                put("s")
            elif k == "x":
                return None
        return _SOFT.sub("i", "".join(out))

    def build(self):
        R = self.role
        args, params, block, members, lists, switch = R("(", "args"), R("(", "params"), R("{", "block"), R("{", "members"), R("{", "list"), R("{", "switch")
        paren = R("(", "args", "params")
        anno = rx(f"@(?!c)i(?:\\.i)*+(?:{ANY_PAREN})?")
        self.first = [
            (anno, ""), (rx("@c"), "c"), (rx(f"(?<=[im.>])<(?:[i.,?x|GM]|p|{ANY_LIST})*+>"), "G"), (rx(f"\\A<(?:[i.,?x|GM]|{ANY_LIST})*+>"), "G"),
        ]
        self.heads = [
            (rx(f"I{args}"), "ι"), (rx(f"W{args}"), "ω"), (rx(f"F{R('(', 'for')}"), "ƒ"), (rx(f"S{args}{switch}"), "σ"), (rx(f"C{params}{block}"), "ç"), (rx(f"Y{R('(', 'resources', 'args')}"), "Y"), (rx(f"m{args}(?={block})"), "λ"),
            (rx(f"wi(?:\\.i)*+G?(?:{args}(?:{members})?|(?:{ANY_LIST})++(?:{lists})?)"), "φ"), (rx(f"{paren}→{block}"), "φ"), (rx(f"i→{block}"), "φ"),
        ]
        atom = f"(?:[ipsφ0σ]|{args})"
        post = f"(?:\\.G?[ip]|{paren}|{ANY_LIST}|#|G)*+"
        unit = f"(?:{paren}→|i→|[!+#]|{args}(?=[ipsφ0!]))*+{atom}{post}"
        op = r"(?:>>?>?|[+*%<|=j&])"
        self.chain = rx(f"(?<!\\.){unit}(?:{op}m?{unit})*+")
        self.rules = [(rx(r"ε\?ε:ε"), "ε"), (rx(f"ε{op}ε"), "ε"), (rx(f"(?:{paren}|i)→ε"), "ε")]
        self.args = rx(r"(?:ε(?:,ε)*+)?")
        self.list = rx(f"(?:(?:ε|{lists})(?:,(?:ε|{lists}))*+,?)?")
        self.params = rx(r"(?:m*+ε\^?ε(?:,m*+ε\^?ε)*+)?")
        self.forhead = rx(r"(?:m*+ε?ε(?:,ε)*+)?;ε?;(?:ε(?:,ε)*+)?|m*+εε:ε")
        self.resources = rx(r"(?:m*+εε|ε)(?:;(?:m*+εε|ε))*+;?")
        init = f"(?:={lists})?"
        body = f"(?:{block}|d{{0}};|;)".replace("{0}", "ε")
        kind = f"m*+(?:cε(?:xε(?:,ε)*+)*+{members}|eε(?:xε(?:,ε)*+)*+{R('{', 'enum')}|εε(?:xε(?:,ε)*+)*+{members})"
        self.member = rx(f";|m*+{block}|{kind}|m*+[dm]?m*+G?(?:ε)?ε(?:xε(?:,ε)*+)?{body}|m*+εε{init}(?:,ε{init})*+;")
        self.enum = rx(f"(?:ε(?:{members})?(?:,ε(?:{members})?)*+,?)?(?:;|\\Z)")
        self.head = rx(r"(?:ι|ƒ|ω(?!;?\Z)|λ|ε:)*+")
        self.stmt = rx(f";|m*+εε{init}(?:,ε{init})*+;|{kind}|Y{block}ç*+(?:N{block})?|σ|Rε?(?::ε)?;|Tε;|Bε?;|D{block}ω;|{block}|ε;|ε={lists};")
        self.case = rx(r"(?:kε(?:,ε)*+|d)(?::|→|(?=;))|kε(?=[;\n])|kεε(?:→|:)")
        self.unit_top = rx(r"(?:K[ε];)?(?:;|Mm?ε(?:\.\*)?;)*+")
        self.kind = rx(f";|{kind}")

    def expr(self, s: str) -> str:
        for p, to in self.first[:2]:
            s = p.sub(to, s)
        if "<" in s:
            while True:
                t = s
                for p, to in self.first[2:]:
                    t = p.sub(to, t)
                if t == s:
                    break
                s = t
        for p, to in self.heads:
            s = p.sub(to, s)
        return settle(self.chain.sub("ε", s), self.rules)

    def has(self, bracket, role, s):
        e = self.expr(s)
        if bracket == "(":
            if role == "args":
                return bool(self.args.fullmatch(e)) or bool(re.fullmatch("ε(?:\\|ε)+", e))
            return bool({"params": self.params, "for": self.forhead, "resources": self.resources}[role].fullmatch(e))
        if bracket == "[":
            return e in ("", "ε")
        if role == "members":
            return sequence(self.member, e)
        if role == "list":
            return bool(self.list.fullmatch(e))
        if role == "enum":
            m = self.enum.match(e)
            return bool(m) and sequence(self.member, e[m.end() :])
        return statements(e, self.head, self.stmt, self.case if role == "switch" else None, role == "switch")

    def top(self, s):
        e = self.expr(re.sub(r"\.\*;", ".i;", s))
        return sequence(self.kind, e[self.unit_top.match(e).end() :])
