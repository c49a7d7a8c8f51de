"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from .core import ANY_BRACE, ANY_LIST, ANY_PAREN, Grammar, rx, sequence, settle, statements

_TOKEN = re.compile(
    r"""(?:[ \t\f\v ﻿]+|//[^\n\r  ]*|\A\#![^\n]*)*(?:
    (?P<n>(?:[\n\r  ]|/\*(?:[^*]|\*(?!/))*\*/)[\s﻿]*)
    |(?P<i>[A-Za-z_$ª-῿Ⰰ-퟿豈-﫿\U00010000-\U0003ffff][\w$]*|\#[A-Za-z_$][\w$]*)
    |(?P<d>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<q>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<t>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*\})*`)
    |(?P<r>(?:(?<=[=(,:\[!&|?{};+\n])|(?<=[=(,:\[!&|?{};+>][ ])|(?<=return[ ])|(?<=typeof[ ])|(?<=case[ ]))/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*)
    |(?P<p>\.\.\.|=>|===|!==|==|!=|<=|>=(?!>)|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|<<=|<<|>>>=|>>=|[-+*/%&|^]=|[(){}\[\];,<>=.?:!~@*/%&|^+-])
    |(?P<x>\S)|\Z)""",
    re.X,
)
# i name, v var, f function, c class, I E F W D R B T Y C N S K d statements, w new, y unary words, j in/instanceof, p this and constants,
# m static, a async, o of, G get/set, A as, r from, M import, X export, x extends, P modifiers, h interface, k type, u namespace, l implements, e enum
_WORDS = {
    "var": "v", "let": "v", "const": "v", "function": "f", "class": "c", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", "return": "R", "break": "B", "continue": "B", "throw": "T", "try": "Y", "catch": "C",
    "finally": "N", "switch": "S", "case": "K", "default": "d", "new": "w", "typeof": "y", "void": "y", "delete": "y", "yield": "y", "await": "y", "instanceof": "j", "in": "j", "this": "p", "super": "p", "null": "p", "true": "p",
    "false": "p", "import": "M", "export": "X", "extends": "x", "debugger": "B", "enum": "e", "async": "a", "of": "o", "get": "G", "set": "G", "static": "m", "as": "A", "from": "r", "with": "H",
}
_TYPED = {
    "public": "P", "private": "P", "protected": "P", "readonly": "P", "abstract": "P", "declare": "P", "override": "P", "implements": "l", "interface": "h", "type": "k", "namespace": "u", "module": "u", "satisfies": "A",
    "keyof": "L", "infer": "L", "unique": "L", "is": "b", "asserts": "L",
}
_OPS = {"=>": "→", "...": "^", "?.": ".", "++": "#", "--": "#", "+": "+", "-": "+", "!": "!", "~": "!", "==": "=", "===": "="}
_ASSIGN = {"*=", "/=", "%=", "+=", "-=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "**=", "&&=", "||=", "??="}
# contextual words are names unless what follows makes them words of the grammar
_PLAIN = re.compile(
    r"(?<=\.)[A-Za-z]|[GmPhkLue](?![\w\[{*@#])|(?<![\w.])(?<!\.)[GmP](?=[jxA](?![\w]))|a(?![\wf(*\[#])|(?<![(v]i)(?<![\]}])o|o(?![\w(\[{+!])|(?<![\w)\]}*%])A|A(?![\w(\[{])|r(?!s)|(?<![\w)])b|b(?![\w({])|l(?!\w)"
)
# functions and classes where a statement begins are declarations
_DECLARED = re.compile(r"(?:\A|(?<=[;\nXdPEιƒωçσ\ue400-\ue5ff]))φ+(?![.(\ue000-\ue3ff])")
_KEY = re.compile(r"(?:(?<=^)|(?<=[,^\n]))[A-Za-z](?=[:])")
_JOIN = re.compile(r"(?<=[,=%*|<>?:.+!→^(\[{jwyAxl])\n|\n(?=[,=%*|<>?:.+→)\]}jA(\[{])")


class Script(Grammar):
    name = "javascript"
    typed = False
    roles = {"(": ["args", "for", "params"], "[": ["list"], "{": ["block", "object", "members", "switch", "type", "enum"]}

    def lex(self, text):
        out, words = [], {**_WORDS, **_TYPED} if self.typed else _WORDS
        get, put = words.get, out.append
        for m in _TOKEN.finditer(text):
            k = m.lastgroup
            if k == "i":
                put(get(m.group("i"), "i"))
            elif k == "p":
                p = m.group("p")
                put(_OPS.get(p) or ("%" if len(p) > 1 and p not in _ASSIGN else "=" if len(p) > 1 else "|" if p in "|&" else "%" if p in "/%^" else p))
            elif k == "n":
                if out and out[-1] != "\n" and not m.group("n").isspace() and "\n" not in m.group("n") or not out or out[-1] == "\n":
                    continue
                put("\n")
            elif k == "d":
                put("0")
            elif k == "q" or k == "r":
                put("s")
            elif k == "t":
                put("t")
            elif k == "x":
                return None
        return _JOIN.sub("", _PLAIN.sub("i", "".join(out)))

    def build(self):
        ts = self.typed
        R = self.role
        soft, name = "i", "i"
        args, block, members, switch = R("(", "args"), R("{", "block"), R("{", "members"), R("{", "switch")
        params = args = R("(", "args", "params")
        obj = R("{", "object", "type") if ts else R("{", "object")
        body = R("{", "type") if ts else "(?!)"
        typ = f"(?:[yLbP]*+(?:[{soft}p](?:\\.{name})*+G?|y|[st0]|{params}→(?:[{soft}p]G?|y|{body})|{args}|{body}|{ANY_LIST})(?:{ANY_LIST})*+)" if ts else "(?!)"
        ann = f"(?::{typ}(?:\\|{typ})*+)?" if ts else ""
        self.generic = rx(f"(?<=[{soft}f.])<(?:v?[{soft}pstxyLbPG0.,|=?:^→]|{ANY_PAREN}|{ANY_LIST}|{ANY_BRACE})*+>(?=[(){{}}\\[\\],;=>.|:\\n→?xl]|{ANY_PAREN}|{ANY_LIST}|{ANY_BRACE}|\\Z)")
        prop = f"(?:\\.(?:{name}|{args}|{ANY_LIST}))"
        func = f"a?f\\*?[{soft}]?G?{params}{ann}\n?{block}"
        klass = f"c(?:[{soft}]G?)?(?:x(?:[{soft}p]|{args})(?:{prop}|{args})*+G?)?" + (f"(?:l{typ}(?:,{typ})*+)?" if ts else "") + f"\n?{members}"
        self.made = [
            (rx(f"(?<!\\.)(?:{func}|{klass})"), "φ"),
            (rx(f"(?<!\\.)(?:a?G?{params}{ann}|(?:a(?=[{soft}]))?[{soft}])→{block}"), "φ"),
            (rx(f"I({args})"), "ι"), (rx(f"W{args}"), "ω"), (rx(f"F{R('(', 'for')}|Fy{R('(', 'for')}"), "ƒ"), (rx(f"S{args}\n?{switch}"), "σ"),
            (rx(f"C(?:{params})?\n?{block}"), "ç"), (rx(f"H{args}"), "ω"),
        ]
        if not ts:
            self.made[4] = (rx(f"F{R('(', 'for')}|Fy{R('(', 'for')}"), "ƒ")
        arrow = f"(?:a?G?{params}{ann}|(?:a(?=[{soft}]))?[{soft}])→"
        inside = f"(?<=[,:=?→^RTK%+*<|>jA!ywdLbMXvk]){obj}"
        atom = f"(?:[φ{soft}pst0ε]|{args}|{ANY_LIST}|{inside}|M(?={args}|\\.)|y(?=[;\n,)\\]}}]|\\Z))"
        post = f"(?:{prop}|G?{args}|{ANY_LIST}|t|#" + (f"|G|!(?=[.;,)\n=%|*?+]|{ANY_LIST}|\\Z)" if ts else "") + ")*+"
        unit = f"(?:{arrow}|[!+#yw{'L' if ts else ''}]|y\\*)*+{atom}{post}"
        op = "(?:>>?>?|[+*%<|=jA" + ("b" if ts else "") + "])"
        self.chain = rx(f"(?<!\\.){unit}(?:{op}{unit})*+")
        self.leading = rx(f"\\A({obj})(?!\\n?{block})")
        self.rules = [(rx(r"ε\?ε:ε"), "ε"), (rx(f"ε{op}ε"), "ε"), (rx(f"{arrow}ε"), "ε"), (rx(r"→ε"), "ε")]
        end = r"(?:[;\n]|\Z)"
        t = r"(?:[?!]?:(?:\|)?ε)?" if ts else ""
        item = r"\^?ε"
        self.args = rx(f"(?:,*{item}(?:,+{item})*+)?,*")
        mod = "(?:[mP])*+" if ts else ""
        param = f"{mod}\\^?ε" + (r"\??(?::\|?ε)?(?:=ε)?" if ts else "")
        self.params = rx(f"(?:{param}(?:,{param})*+,?)?")
        self.forhead = rx(f"(?:vε{t}(?:,ε{t})*+|ε(?:,ε)*+)?;(?:ε(?:,ε)*+)?;(?:ε(?:,ε)*+)?|v?ε(?:o|j)ε(?:,ε)*+|v?ε")
        meth = f"ε(?:[?!])?{t}\n?{block}"
        self.prop = rx(f"(?:(?:\\^ε|ε:ε|ε|(?:[aG]|\\*)*+{meth})(?:,|\\Z))*+")
        deco = r"(?:@ε\n?)*+"
        self.member = rx(
            f"[;\n]|m?{block}|{deco}(?:[mP]\n?)*+(?:[aG](?=[ε*\\[]))*+\\*?{meth}|{deco}(?:[mP]\n?)*+[aG]?ε{t}" + (r"\??(?:=ε)?" if ts else "") + f"{end}|{deco}[mPaG]+ε?{end}"
        )
        self.sig = rx(r"(?:[;,\n]|(?:\+?P)?G?ε\??(?:\+?\?)?(?::\|?ε)?(?:[;,\n]|\Z))")
        self.enum = rx(r"(?:ε(?:,|\Z))*+")
        from_ = "(?:rε)"
        export = f"X(?:\\*(?:ε)?{from_}?{end}|\\*ε{end}|k?ε(?:,ε)*+{from_}?{end}|d?(?=[vδεPhkceua])|d\n?)"
        self.head = rx(r"(?:ι\n?|ƒ\n?|ω\n?(?!;?\Z)|ε:\n?)*+")
        typed = f"|P*+hε(?:xε(?:,ε)*+)?\n?(?:{body})?|kε{end}|v?eε\n?(?:{ANY_BRACE})?|u?ε\n?{block}|P+(?=[δvhkeuf])|a?f\\*?ε{t}{end}" if ts else ""
        self.stmt = rx(
            f"[;\n]|vε{t}(?:,\n?ε{t})*+{end}|δ(?:{end})?|{deco}{export}|@ε\n?|M(?:ε(?:,ε)*+{from_}|ε,\\*ε{from_}|k?\\*ε{from_}|kε{from_}|ε|\\*{from_}){end}{typed}|Y\n?{block}\n?(?:ç\n?(?:N\n?{block})?|N\n?{block})|σ"
            f"|R(?:ε(?:,ε)*+)?{end}|Tε{end}|Bε?{end}|D\n?{block}\n?ω;?|{block}|ε(?:,ε)*+{end}"
        )
        self.labels = rx(r"(?:\A|(?<=[;\n\ue400-\ue5ff]))(?:K[^:?]*:|d:)")
        self.case = rx(r"(?:Kε(?:,ε)*+:|d:)")

    def value(self, s: str) -> str:
        """`expr` where an object may come first."""
        return self.expr(self.leading.sub("φ", s))

    def expr(self, s: str, stmts: bool = False) -> str:
        if self.typed and "<" in s:
            while True:
                t = self.generic.sub("G", s)
                if t == s:
                    break
                s = t
        for p, to in self.made:
            s = p.sub(to, s)
        if stmts and "φ" in s:
            s = _DECLARED.sub(lambda m: "δ" * len(m.group()), s)
        s = self.chain.sub("ε", s)
        return settle(s, self.rules)

    def has(self, bracket, role, s):
        if bracket == "(":
            flat = s.replace("\n", "")
            if role == "args":
                return bool(self.args.fullmatch(self.value(flat)))
            if role == "params":
                return self.typed and bool(self.params.fullmatch(self.value(flat)))
            return ";" in s and bool(self.forhead.fullmatch(self.value(flat))) or bool(re.search("[oj]", s)) and bool(self.forhead.fullmatch(self.expr(re.sub(r"(?<=.)o(?=.)", "j", flat, count=1))))
        if bracket == "[":
            flat = s.replace("\n", "")
            return bool(self.args.fullmatch(self.value(flat))) or self.typed and bool(self.params.fullmatch(self.value(flat)))
        if role == "object":
            return bool(self.prop.fullmatch(self.expr(s.replace("\n", ""))))
        if role == "members":
            return sequence(self.member, self.expr(s))
        if role == "type":
            return self.typed and sequence(self.sig, self.expr(s))
        if role == "enum":
            return self.typed and bool(self.enum.fullmatch(self.expr(s.replace("\n", ""))))
        e = self.expr(s, True)
        if role == "switch":
            e = self.expr(self.labels.sub(lambda m: m.group() + "\n", s), True)
            return statements(e, self.head, self.stmt, self.case, True)
        return statements(e, self.head, self.stmt)

    def top(self, s):
        return statements(self.expr(s, True), self.head, self.stmt)


class Typed(Script):
    name = "typescript"
    typed = True
