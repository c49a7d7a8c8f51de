"""Node trees of source code: what is declared where, down to statements, without a full parse.

A tree serves to cut a source along its structure and to find its symbols, so it needs declarations, their names, bodies
and statements, and must come out of any text, also of one that does not parse. A scanner per family of languages tells
strings and comments from code and pairs brackets; items of a body then end at semicolons, at line ends or with a block,
and their first words say what they are. Python's trees come from its own parser. What lies between items - comments -
becomes a node of its own. Node types are those in wide use for these languages (see GRAMMARS).
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Node:
    """start and end are (row, column) from 0; bytes are half-open."""

    type: str
    start: tuple[int, int]
    end: tuple[int, int]
    start_byte: int
    end_byte: int
    name: str | None = None
    text: str = ""
    children: list["Node"] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.end_byte - self.start_byte


@dataclass(frozen=True)
class Grammar:
    """Node types by role. `wrapper` types stand for what they wrap; `decorator` goes with what follows it; names come
    from the node itself, or, with `names_in_children`, from the first child of an identifier type."""

    function: frozenset[str]
    cls: frozenset[str]
    namespace: frozenset[str] = frozenset()
    wrapper: frozenset[str] = frozenset()
    decorator: str | None = None
    function_name: frozenset[str] = frozenset()
    class_name: frozenset[str] = frozenset()
    namespace_name: frozenset[str] = frozenset()
    names_in_children: bool = False

    def roles(self) -> dict[str, frozenset[str]]:
        return {
            "function": self.function, "class": self.cls, "namespace": self.namespace, "wrapper": self.wrapper, "decorator": frozenset([self.decorator] if self.decorator else []),
            "function_name": self.function_name, "class_name": self.class_name, "namespace_name": self.namespace_name,
        }


def _g(function: str, cls: str, namespace: str = "", wrapper: str = "", decorator: str | None = None, names: tuple[str, str, str] = ("", "", ""), names_in_children: bool = False) -> Grammar:
    f = lambda s: frozenset(s.split())
    return Grammar(f(function), f(cls), f(namespace), f(wrapper), decorator, f(names[0]), f(names[1]), f(names[2]), names_in_children)


# fixed values: node types of each language by role
_SCRIPT = ("method_definition function_declaration generator_function_declaration", "class_declaration abstract_class_declaration", "namespace internal_module", "expression_statement")
_SCRIPT_NAMES = ("property_identifier identifier", "type_identifier", "identifier")
GRAMMARS: dict[str, Grammar] = {
    "python": _g("function_definition", "class_definition", "", "decorated_definition", "decorator", ("identifier", "identifier", "")),
    "java": _g(
        "method_declaration function_declaration constructor_declaration lambda_expression annotation_type_declaration", "class_declaration abstract_class_declaration interface_declaration enum_declaration",
        names=("identifier", "identifier", ""),
    ),
    "javascript": _g(*_SCRIPT, names=_SCRIPT_NAMES, names_in_children=True),
    "typescript": _g(*_SCRIPT, names=_SCRIPT_NAMES),
    "tsx": _g(*_SCRIPT, names=_SCRIPT_NAMES),
    "kotlin": _g("function_declaration lambda_expression anonymous_function constructor_declaration", "class_declaration object_declaration interface_declaration", names=("simple_identifier", "type_identifier", "")),
    "ruby": _g("method singleton_method class_method", "class singleton_class", "module", names=("identifier constant", "constant", "constant")),
    "swift": _g(
        "function_declaration method_declaration initializer_declaration subscript_declaration operator_declaration init_declaration", "class_declaration struct_declaration enum_declaration protocol_declaration extension_declaration",
        names=("simple_identifier identifier", "simple_identifier identifier type_identifier", ""),
    ),
}


def is_function(n: Node, g: Grammar) -> bool:
    if g.names_in_children and (_declares(n) or n.type == "pair" and any(c.type == "function_expression" for c in n.children)):
        return True
    return any(c.type in g.function for c in n.children) if n.type in g.wrapper else n.type in g.function


def _declares(n: Node) -> bool:
    """A constant or variable with a name of its own."""
    return n.type == "lexical_declaration" and any(c.type == "variable_declarator" and any(x.type == "identifier" for x in c.children) for c in n.children)


def is_class(n: Node, g: Grammar) -> bool:
    return any(c.type in g.cls for c in n.children) if n.type in g.wrapper else n.type in g.cls


def is_namespace(n: Node, g: Grammar) -> bool:
    return n.type in g.namespace


def is_breakable(n: Node, g: Grammar) -> bool:
    """Whether a span begins with the node."""
    kinds = g.function | g.cls | g.namespace
    if n.type in g.wrapper:
        return any(c.type in kinds for c in n.children)
    return n.type in kinds or g.names_in_children and is_function(n, g)


def name_of(n: Node, g: Grammar) -> str | None:
    if n.name is not None and not g.names_in_children:
        return n.name
    idents = g.function_name | g.class_name | g.namespace_name
    if n.type in idents:
        return n.text
    for c in n.children:
        if c.type in idents:
            return c.text
    inner = g.cls | g.function | g.namespace_name | ({"variable_declarator"} if g.names_in_children else set())
    return next((got for c in n.children if c.type in inner and (got := name_of(c, g))), None)


class _Source:
    """Offsets of a text in rows, columns and bytes."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()
        if not self.ascii:
            self.bytes = [0]
            for a, b in zip(self.starts, [*self.starts[1:], len(text)]):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))

    def point(self, at: int) -> tuple[int, int]:
        row = bisect.bisect_right(self.starts, at) - 1
        return row, at - self.starts[row]

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        row, col = self.point(at)
        return self.bytes[row] + len(self.text[self.starts[row] : self.starts[row] + col].encode("utf-8", "surrogatepass"))

    def node(self, kind: str, a: int, b: int, name: str | None = None, children: list[Node] | None = None) -> Node:
        return Node(kind, self.point(a), self.point(b), self.byte(a), self.byte(b), name, self.text[a:b] if b - a <= 80 else "", children or [])

    def filled(self, nodes: list[tuple[int, int, Node]], a: int, b: int) -> list[Node]:
        """The nodes (with their offsets) in a..b and, where text other than white space lies between them, comments."""
        out, at = [], a
        for x, y, n in [*nodes, (b, b, None)]:
            gap = self.text[at:x]
            if gap.strip():
                lead = len(gap) - len(gap.lstrip())
                out.append(self.node("comment", at + lead, at + len(gap.rstrip())))
            if n is not None:
                out.append(n)
            at = max(at, y)
        return out


# Python


def python_tree(text: str) -> Node:
    """By Python's own parser; SyntaxError where it fails."""
    src = _Source(text)
    raw = [len(x.encode("utf-8", "surrogatepass")) for x in text.split("\n")]

    def offset(line: int, col: int) -> int:
        start = src.starts[line - 1]
        end = src.starts[line] if line < len(src.starts) else len(text)
        row = text[start:end]
        return start + (col if len(row) == raw[line - 1] + (row[-1:] == "\n") else len(row.encode("utf-8", "surrogatepass")[:col].decode("utf-8", "ignore")))

    def body(stmts: list[ast.stmt], a: int, b: int) -> list[Node]:
        return src.filled([statement(s) for s in stmts], a, b)

    def statement(s: ast.stmt) -> tuple[int, int, Node]:
        a, b = offset(s.lineno, s.col_offset), offset(s.end_lineno, s.end_col_offset)
        lists = [v for k in ("body", "handlers", "orelse", "finalbody", "cases") for v in [getattr(s, k, None)] if isinstance(v, list) and v]
        kids: list[tuple[int, int, Node]] = []
        for stmts in lists:
            for x in stmts:
                if isinstance(x, ast.stmt):
                    kids.append(statement(x))
                else:  # a handler or case
                    kids += [statement(y) for y in x.body]
        kids.sort(key=lambda k: k[0])
        if isinstance(s, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "class_definition" if isinstance(s, ast.ClassDef) else "function_definition"
            first = kids[0][0]
            block = src.node("block", first, b, None, src.filled(kids, first, b))
            head = src.node("header", a, max(a, len(text[:first].rstrip())))
            n = src.node(kind, a, b, s.name, [head, block])
            if s.decorator_list:
                marks = [(x := text.rindex("@", 0, offset(d.lineno, d.col_offset) + 1), y := offset(d.end_lineno, d.end_col_offset), src.node("decorator", x, y)) for d in s.decorator_list]
                whole = marks[0][0]
                return whole, b, src.node("decorated_definition", whole, b, None, src.filled([*marks, (a, b, n)], whole, b))
            return a, b, n
        kinds = {ast.Import: "import_statement", ast.ImportFrom: "import_from_statement"}
        return a, b, src.node(kinds.get(type(s), "statement"), a, b, None, src.filled(kids, a, b) if kids else [])

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        module = ast.parse(text)
    return src.node("module", 0, len(text), None, body(module.body, 0, len(text)))


# languages with braces

_COMMON = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_STRING = r'"""(?:[^\\"]|\\.|"(?!""))*(?:"""|\Z)|"(?:[^"\\\n]|\\.)*"?'
_CHAR = r"'(?:[^'\\\n]|\\.)*'?"
_REST = r"(?P<word>[@#$\w]+)|(?P<nl>\n)|(?P<op>=>|->|\?\.|::|&&|\|\||[^\s\w])"
_SCANNERS = {
    "java": re.compile(rf"(?P<skip>{_COMMON})|(?P<str>{_STRING}|{_CHAR})|{_REST}", re.S),
    "script": re.compile(rf"(?P<skip>{_COMMON})|(?P<str>\"(?:[^\"\\\n]|\\.)*\"?|{_CHAR}|`(?:[^`\\]|\\.)*`?|(?<=[=(,:\[!&|?{{;\n])[ \t]*/(?![*/\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*)|{_REST}", re.S),
    "kotlin": re.compile(rf"(?P<skip>{_COMMON})|(?P<str>\"\"\".*?(?:\"\"\"+|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|{_CHAR})|{_REST}", re.S),
    "swift": re.compile(rf"(?P<skip>{_COMMON})|(?P<str>\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?)|{_REST}", re.S),
}
_MODIFIERS = frozenset("public private protected internal static final abstract async export default declare open override sealed data inline inner companion suspend tailrec operator infix external const lateinit readonly synchronized native transient volatile strictfp mutating nonmutating fileprivate indirect lazy weak unowned required convenience dynamic optional annotation value vararg noinline crossinline expect actual get set nonisolated".split())
_CONTINUES = frozenset(". ?. , ; ) ] = ? : && || + - * / % & | ^ ( [ => -> ::".split())
_FOLLOWS_BLOCK = frozenset("else catch finally while".split())


@dataclass
class _Token:
    kind: str  # word, op or str
    text: str
    a: int
    b: int
    fresh: bool  # first of its line


def _scan(text: str, scanner: re.Pattern) -> list[_Token]:
    out, fresh = [], True
    for m in scanner.finditer(text):
        k = m.lastgroup
        if k == "nl":
            fresh = True
        elif k == "skip":
            fresh = fresh or "\n" in m.group()
        else:
            out.append(_Token(k, m.group() if k != "str" else '"', m.start(), m.end(), fresh))
            fresh = False
    return out


def _pairs(tokens: list[_Token]) -> dict[int, int]:
    """Opening -> closing bracket. A closing one without its opening is passed over, an opening one reaches to the end."""
    out, stack = {}, []
    closing = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in "([{":
            stack.append(i)
        elif t.kind == "op" and t.text in closing:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if tokens[stack[d]].text == closing[t.text]), None)
            if depth is not None:
                for k in stack[depth + 1 :]:
                    out[k] = i - 1
                out[stack[depth]] = i
                del stack[depth:]
    for k in stack:
        out[k] = len(tokens) - 1
    return out


class _Braces:
    def __init__(self, text: str, language: str):
        self.src, self.language = _Source(text), language
        self.family = "script" if language in ("javascript", "typescript", "tsx") else language
        self.tokens = _scan(text, _SCANNERS[self.family])
        self.pairs = _pairs(self.tokens)
        self.by_line = self.family != "java"

    def tree(self) -> Node:
        root = {"java": "program", "script": "program", "kotlin": "source_file", "swift": "source_file"}[self.family]
        text = self.src.text
        return self.src.node(root, 0, len(text), None, self.src.filled(self.items(0, len(self.tokens), None), 0, len(text)))

    def items(self, i: int, j: int, owner: str | None) -> list[tuple[int, int, Node]]:
        """Items of the tokens i..j; `owner` is the kind of the body they stand in (None for statements)."""
        out = []
        while i < j:
            k = self.item_end(i, j, owner)
            out.append((self.tokens[i].a, self.tokens[k - 1].b, self.item(i, k, owner)))
            if owner == "enum" and self.tokens[k - 1].text == ";":
                owner = "class"  # members follow the constants
            i = k
        return out

    def item_end(self, i: int, j: int, owner: str | None) -> int:
        toks, k = self.tokens, i
        head = self.first_word(i, j)
        while k < j:
            t = toks[k]
            if t.kind == "op" and t.text in "([{":
                block = t.text == "{"
                k = min(self.pairs.get(k, j - 1), j - 1) + 1
                if block and k < j:
                    n = toks[k]
                    if n.text in _FOLLOWS_BLOCK and head in ("if", "try", "do", "else"):
                        continue
                    if n.kind == "op" and n.text in _CONTINUES and not (n.text in "([" and n.fresh):
                        if n.text == ";":
                            return k + 1
                        continue
                    if head in ("const", "let", "var", "val", "return", "import", "export") and not n.fresh:
                        continue
                    return k
                continue
            k += 1
            if t.text == ";" and t.kind == "op":
                return k
            if owner == "enum" and t.text == "," and t.kind == "op":
                return k
            if self.by_line and k < j and toks[k].fresh:
                n = toks[k]
                if head in ("import", "package") and self.family != "script":
                    return k
                if not (t.kind == "op" and t.text in _CONTINUES - {")", "]", "?"}) and not (n.kind == "op" and n.text in (_CONTINUES | {"{"}) - {"(", "["}) and n.text not in _FOLLOWS_BLOCK | {"where", "extends", "implements", "by"}:
                    if self.marks(i, k) < k:
                        return k
        return j

    def marks(self, i: int, j: int) -> int:
        """Index of the first token after annotations and modifiers."""
        toks = self.tokens
        while i < j:
            t = toks[i]
            if t.kind == "word" and t.text.startswith("@") and t.text != "@interface":
                i += 1
                while i + 1 < j and toks[i].text in (".", ":") and toks[i + 1].kind == "word":
                    i += 2
                if i < j and toks[i].text == "(" and not toks[i].fresh:
                    i = self.pairs.get(i, j - 1) + 1
            elif t.kind == "op" and t.text == "@" and i + 1 < j:
                i += 2
            elif t.kind == "word" and t.text in _MODIFIERS and not (t.text == "const" and self.family == "script") and i + 1 < j and not (toks[i + 1].kind == "op" and toks[i + 1].text in "(=:.,;)"):
                i += 1
            else:
                break
        return i

    def first_word(self, i: int, j: int) -> str:
        k = self.marks(i, j)
        return self.tokens[k].text if k < j else ""

    def item(self, i: int, j: int, owner: str | None) -> Node:
        toks, src = self.tokens, self.src
        a, b = toks[i].a, toks[j - 1].b
        k = self.marks(i, j)
        if self.family == "script" and any(t.text == "export" for t in toks[i:k]):
            e = next(x for x in range(i, k) if toks[x].text == "export")
            e += 2 if e + 1 < j and toks[e + 1].text == "default" else 1
            if e < j:
                inner = self.item(e, j, owner)
                return src.node("export_statement", a, b, None, [src.node("export", a, toks[e - 1].b), inner])
        kind, name, body = self.classified(i, k, j, owner)
        kids = self.parts(i, j, body) or [src.node("header", a, b)] * (name is not None)
        if self.family == "script" and kind == "lexical_declaration":
            ident = next((x for x in range(k + 1, j) if toks[x].kind == "word"), None)
            if ident is not None and not (k + 1 < j and toks[k + 1].text in "[{"):
                who = src.node("identifier", toks[ident].a, toks[ident].b)
                rest = self.parts(ident + 1, j, None)
                return src.node(kind, a, b, toks[ident].text, [src.node("variable_declarator", toks[ident].a, b, toks[ident].text, [who, *rest])])
        elif self.family == "script" and name is not None:
            at = next((x for x in range(k, j) if toks[x].text == name), None)
            if at is not None:
                kids = [src.node("property_identifier" if kind == "method_definition" else "identifier", toks[at].a, toks[at].b), *kids]
        n = src.node(kind, a, b, name, kids)
        if self.family == "script" and kind in ("internal_module", "namespace"):
            return src.node("expression_statement", a, b, None, [n])
        return n

    def parts(self, i: int, j: int, body: str | None) -> list[Node]:
        """What an item consists of: stretches before and between its blocks, and the blocks with their items."""
        toks, src, out, at, k = self.tokens, self.src, [], i, i
        has_block = any(toks[x].text == "{" and toks[x].kind == "op" for x in range(i, j))
        if not has_block:
            return []
        while k < j:
            t = toks[k]
            if t.kind == "op" and t.text in "([":
                k = min(self.pairs.get(k, j - 1), j - 1) + 1
                continue
            if t.kind == "op" and t.text == "{":
                close = min(self.pairs.get(k, j - 1), j - 1)
                if at < k:
                    out.append(src.node("header", toks[at].a, toks[k - 1].b))
                inner = self.items(k + 1, close, body) if close > k else []
                ends = [(t.a, t.b, src.node("{", t.a, t.b)), *inner, (toks[close].a, toks[close].b, src.node("}", toks[close].a, toks[close].b))] if close > k else [(t.a, t.b, src.node("{", t.a, t.b))]
                out.append(src.node("class_body" if body else "block", t.a, toks[close].b, None, src.filled(ends, t.a, toks[close].b)))
                k = at = close + 1
                continue
            k += 1
        if at < j:
            out.append(src.node("header", toks[at].a, toks[j - 1].b))
        return out

    def name_after(self, k: int, j: int) -> str | None:
        for t in self.tokens[k + 1 : min(j, k + 8)]:
            if t.kind == "word":
                return t.text
            if t.text in ("{", "(", "=", ";"):
                break
        return None

    def classified(self, i: int, k: int, j: int, owner: str | None) -> tuple[str, str | None, str | None]:
        """(node type, name, kind of its body: 'class', 'enum' or None for statements)."""
        toks = self.tokens
        if k >= j:
            return "statement", None, None
        w = toks[k].text if toks[k].kind == "word" else ""
        marks = {t.text for t in toks[i:k]}
        named = lambda: self.name_after(k, j)
        if self.family == "java":
            if w in ("class", "record"):
                return ("class_declaration" if w == "class" else "record_declaration"), named(), "class"
            if w == "interface":
                return "interface_declaration", named(), "class"
            if w == "enum":
                return "enum_declaration", named(), "enum"
            if w == "@interface":
                return "annotation_type_declaration", named(), "class"
            if w in ("import", "package"):
                return f"{w}_declaration", None, None
            if owner == "enum":
                return "enum_constant", None, "class"
            if owner == "class":
                call = self.parameters(k, j)
                if call is not None:
                    name = toks[call - 1].text
                    return ("constructor_declaration" if call - 1 == k else "method_declaration"), name, None
                return "field_declaration", None, None
        elif self.family == "script":
            if w == "class":
                return ("abstract_class_declaration" if "abstract" in marks else "class_declaration"), named(), "class"
            if w == "function":
                star = k + 1 < j and toks[k + 1].text == "*"
                return ("generator_function_declaration" if star else "function_declaration"), named(), None
            if w in ("interface", "enum") and self.language != "javascript":
                return f"{w}_declaration", named(), "enum" if w == "enum" else "class"
            if w == "type" and self.language != "javascript" and k + 1 < j and toks[k + 1].kind == "word":
                return "type_alias_declaration", named(), None
            if w in ("namespace", "module") and k + 1 < j and toks[k + 1].kind in ("word", "str") and any(t.text == "{" for t in toks[k + 1 : k + 4]):
                return "internal_module", named(), None
            if w == "import":
                return "import_statement", None, None
            if w in ("const", "let") or "const" in marks and owner is None:
                return "lexical_declaration", named(), None
            if owner == "class":
                call = self.parameters(k, j)
                if call is not None and any(t.text == "{" for t in toks[call:j]):
                    return "method_definition", toks[call - 1].text, None
                return "field_definition", None, None
        elif self.family == "kotlin":
            if w in ("class", "interface", "enum"):
                at = k + 1 if w == "enum" and k + 1 < j and toks[k + 1].text == "class" else k
                return "class_declaration", self.name_after(at, j), "enum" if w == "enum" else "class"
            if w == "object":
                return ("companion_object" if "companion" in marks else "object_declaration"), named(), "class"
            if w == "fun":
                if k + 1 < j and toks[k + 1].text == "interface":
                    return "class_declaration", self.name_after(k + 1, j), "class"
                call = self.parameters(k, j)
                return "function_declaration", (toks[call - 1].text if call else named()), None
            if w in ("val", "var"):
                return "property_declaration", None, None
            if w in ("import", "package"):
                return f"{w}_header", None, None
            if w in ("constructor", "init"):
                return ("secondary_constructor" if w == "constructor" else "anonymous_initializer"), None, None
        elif self.family == "swift":
            if w in ("class", "struct", "enum", "extension", "actor", "protocol") and not (w == "class" and k + 1 < j and toks[k + 1].text in ("func", "var")):
                return ("protocol_declaration" if w == "protocol" else "class_declaration"), named(), "class"
            if w == "class":
                return self.classified(i, k + 1, j, owner)
            if w == "func":
                return "function_declaration", named(), None
            if w in ("init", "subscript", "deinit"):
                return f"{w}_declaration", w, None
            if w in ("let", "var"):
                return "property_declaration", None, None
            if w == "import":
                return "import_declaration", None, None
        return "statement", None, None

    def parameters(self, k: int, j: int) -> int | None:
        """Index of the bracket of the parameters of the method that begins at k; None for fields and calls."""
        toks, x = self.tokens, k
        while x < j:
            t = toks[x]
            if t.kind == "op":
                if t.text == "(":
                    return x if x > k and toks[x - 1].kind == "word" else None
                if t.text == "[" and x > k:
                    x = self.pairs.get(x, j) + 1
                    continue
                if t.text in ("=", "{", ";", "=>"):
                    return None
            x += 1
        return None


# Ruby

_RUBY = re.compile(
    r"(?P<skip>^=begin\b.*?^=end\b[^\n]*|\#[^\n]*)|(?P<doc><<[~-]?(['\"]?)(?P<tag>[A-Z_]\w*)\3)|(?P<str>\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?|`[^`]*`?|:\"[^\"]*\"|%[wWiIqQ]?[\[({][^\])}]*[\])}]|(?<=[(,=~|&!\[ ])/(?![\s/=])(?:[^/\\\n]|\\.)+/\w*)|(?P<word>[@$:]*[A-Za-z_]\w*[?!]?:?)|(?P<nl>\n)|(?P<op>[^\s\w])",
    re.S | re.M,
)
_RUBY_OPEN = frozenset("class module def begin case if unless while until for do".split())


def ruby_tree(text: str) -> Node:
    src = _Source(text)
    tokens: list[_Token] = []
    fresh, at, waiting = True, 0, []
    while at < len(text):
        m = _RUBY.search(text, at)
        if m is None:
            break
        at = m.end()
        k = m.lastgroup if m.lastgroup != "tag" else "doc"
        if m.group("doc"):
            waiting.append(m.group("tag"))
            tokens.append(_Token("str", '"', m.start(), m.end(), fresh))
            fresh = False
        elif k == "nl":
            fresh = True
            for tag in waiting:  # here documents begin on the next line
                end = re.compile(rf"^[ \t]*{tag}[ \t]*$", re.M).search(text, at)
                at = end.end() if end else len(text)
            waiting = []
        elif k == "skip":
            fresh = fresh or "\n" in m.group()
        else:
            tokens.append(_Token(k, '"' if k == "str" else m.group(), m.start(), m.end(), fresh))
            fresh = False

    def opens(i: int) -> bool:
        t = tokens[i]
        if t.kind != "word" or t.text not in _RUBY_OPEN or i and tokens[i - 1].text in (".", "&.") and not t.fresh:
            return False
        if t.text in ("if", "unless", "while", "until") and not t.fresh:
            before = tokens[i - 1]
            return before.kind == "op" and before.text in "=([,|&{;"
        if t.text == "do":  # one that belongs to a loop opens nothing new
            x = i
            while x > 0 and not tokens[x].fresh:
                x -= 1
            return tokens[x].text not in ("while", "until", "for") or not tokens[x].fresh
        if t.text == "def":  # without an end: def f(x) = y
            x, depth = i + 1, 0
            while x < len(tokens) and (depth or not tokens[x].fresh):
                z = tokens[x].text
                depth += (z == "(") - (z == ")")
                if z == "=" and not depth:
                    return x + 1 < len(tokens) and tokens[x + 1].text == "=" or tokens[x - 1].text not in (")",) and tokens[x - 1].b == tokens[x].a
                x += 1
        return True

    closing: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if opens(i) or t.kind == "op" and t.text in "([{":
            stack.append(i)
        elif t.kind == "op" and t.text in ")]}" or t.kind == "word" and t.text == "end" and not (i and tokens[i - 1].text == "."):
            want = {")": "(", "]": "[", "}": "{"}.get(t.text)
            d = next((d for d in range(len(stack) - 1, -1, -1) if (tokens[stack[d]].text == want if want else tokens[stack[d]].kind == "word")), None)
            if d is not None:
                closing[stack[d]] = i
                del stack[d:]
    for k in stack:
        closing[k] = len(tokens) - 1

    def items(i: int, j: int) -> list[tuple[int, int, Node]]:
        out = []
        while i < j:
            k = i
            while k < j:
                k = closing[k] + 1 if k in closing and closing[k] >= k else k + 1
                if k < j and tokens[k].fresh and not (tokens[k].kind == "op" and tokens[k].text in ".&") and not (tokens[k - 1].kind == "op" and tokens[k - 1].text in ",.+-*/|&=\\("):
                    break
            k = min(k, j)
            out.append((tokens[i].a, tokens[k - 1].b, item(i, k)))
            i = k
        return out

    def item(i: int, j: int) -> Node:
        a, b = tokens[i].a, tokens[j - 1].b
        k = i
        while k + 1 < j and tokens[k].text in ("private", "public", "protected", "private_class_method", "module_function") and not tokens[k + 1].fresh:
            k += 1
        w = tokens[k].text if tokens[k].kind == "word" else ""
        kind, name = "statement", None
        if w == "def":
            names = [x for x in range(k + 1, min(j, k + 5)) if not tokens[x].fresh]
            single = len(names) > 2 and tokens[names[1]].text == "."
            kind = "singleton_method" if single else "method"
            name = tokens[names[2 if single else 0]].text if names else None
        elif w in ("class", "module"):
            if k + 1 < j and tokens[k + 1].text == "<":
                kind, name = "singleton_class", next((tokens[x].text for x in range(k + 1, min(j, k + 5)) if tokens[x].kind == "word"), None)
            else:
                parts = []
                x = k + 1
                while x < j and (not parts or not tokens[x].fresh) and (tokens[x].kind == "word" and tokens[x].text[0].isupper() or tokens[x].text in (":", "::")):
                    parts.append(tokens[x].text)
                    x += 1
                kind, name = w, "".join(parts) or None
        elif w in ("require", "require_relative", "include", "extend", "load"):
            kind = "call"
        kids: list[Node] = []
        if k in closing and tokens[k].kind == "word" and w in _RUBY_OPEN and closing[k] < j:
            first = k + 1
            while first < closing[k] and not tokens[first].fresh:
                first = closing[first] + 1 if first in closing and tokens[first].kind == "op" else first + 1
            close = closing[k]
            head = src.node("header", a, tokens[first - 1].b)
            inner = items(first, close)
            kids = src.filled([(a, tokens[first - 1].b, head), *inner, (tokens[close].a, tokens[close].b, src.node("end", tokens[close].a, tokens[close].b))], a, b)
        return src.node(kind, a, b, name, kids or [src.node("header", a, b)] * (name is not None))

    return src.node("program", 0, len(text), None, src.filled(items(0, len(tokens)), 0, len(text)))


def _braces(language: str) -> Callable[[str], Node]:
    return lambda text: _Braces(text, language).tree()


#: Parsers of texts to trees; others can be added.
PARSERS: dict[str, Callable[[str], Node]] = {"python": python_tree, "ruby": ruby_tree, **{k: _braces(k) for k in ("java", "javascript", "typescript", "tsx", "kotlin", "swift")}}
