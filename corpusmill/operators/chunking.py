"""Chunking sources: spans along node trees, strategies, and the folds that merge spans. One row's text is one unit of work."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from corpusmill.operators.trees import GRAMMARS, PARSERS, Grammar, Node, is_breakable, is_class, is_function, is_namespace, name_of

Mention = tuple[str, str]  # (kind, name): 'class', 'function', or a namespace's node type


@dataclass(frozen=True)
class Span:
    """Rows and columns from 0, as nodes have them; size in bytes of what was put in."""

    start: tuple[int, int]
    end: tuple[int, int]
    size: int
    hierarchy: tuple[Mention, ...] = ()
    classes: frozenset[str] = frozenset()
    functions: frozenset[str] = frozenset()
    dechunk: bool = True
    import_only: bool = False

    def __add__(self, other: "Span") -> "Span":
        """Start of the left, end of the right; hierarchies keep first mentions; sizes add up."""
        return Span(
            self.start, other.end, self.size + other.size, tuple(dict.fromkeys(self.hierarchy + other.hierarchy)), self.classes | other.classes, self.functions | other.functions, self.dechunk and other.dechunk,
            self.import_only or other.import_only,
        )

    @property
    def names(self) -> tuple[list[str], list[str]]:
        """(classes, functions) of the hierarchy, each once in order."""
        pick = lambda kind: list(dict.fromkeys(n for k, n in self.hierarchy if k == kind))
        return pick("class"), pick("function")


def mention(n: Node, g: Grammar) -> Mention | None:
    """What a node names, if it is a class, function or namespace with a name."""
    kind = "function" if is_function(n, g) else "class" if is_class(n, g) else n.type if is_namespace(n, g) else None
    name = name_of(n, g) if kind else None
    return (kind, name) if name else None


def mentions(n: Node, g: Grammar) -> list[Mention]:
    """All that is named in a node and below it, in the order of the text."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if m := mention(x, g):
            out.append(m)
        todo += reversed(x.children)
    return out


@dataclass
class Cut:
    """Spans of a tree, and every mention of a class or function that was met on the way (a large one twice: as a child
    and when it was entered)."""

    spans: list[Span] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)

    def note(self, m: Mention | None) -> None:
        if m and m[0] in ("class", "function"):
            (self.classes if m[0] == "class" else self.functions).append(m[1])


def tree_spans(root: Node, g: Grammar, most: int, lines: list[str]) -> Cut:
    """Spans along a tree. A child that is larger than `most` is entered, and is on the hierarchy of what lies in it; a
    class, function or namespace begins a span, as does a child for which the running span has no room, measured in whole
    lines; other children join the running span. A large child without parts is a span of its own, but a name is none. Decorators wait for the node they belong to. A span that holds none of
    these and lies on the top level is import-only, and knows all classes and functions of the file."""
    cut, ends, names = Cut(), [0], g.function_name | g.class_name | g.namespace_name
    for x in lines:
        ends.append(ends[-1] + len(x) + 1)

    def width(s: Span | None) -> int:
        return 0 if s is None else max(ends[min(s.end[0] + 1, len(lines))] - ends[min(s.start[0], len(lines))] - 1, 0)

    waiting: list[tuple[int, int]] = []  # where decorators begin

    def begun(n: Node, path: tuple[Mention, ...], start: tuple[int, int], end: tuple[int, int], size: int) -> Span:
        breaks = is_breakable(n, g)
        inner = path + tuple(mentions(n, g)) if breaks and size > 0 else path
        return Span(start, end, size, tuple(dict.fromkeys(inner)) if breaks and size > 0 else path, dechunk=not breaks, import_only=not path and not breaks)

    def first(n: Node) -> tuple[int, int]:
        at = waiting[0] if waiting else n.start
        waiting.clear()
        return at

    def put(s: Span | None) -> None:
        if s is not None and s.start != s.end:
            cut.spans.append(s)

    def enter(n: Node, path: tuple[Mention, ...]) -> None:
        if n.type not in g.wrapper:
            m = mention(n, g)
            cut.note(m)
            path = path + (m,) if m else path
        run: Span | None = begun(n, path, first(n), n.start, 0)
        for c in n.children:
            cut.note(mention(c, g))
            if c.type == g.decorator:
                waiting.append(c.start)
            elif c.size > most and (c.children or c.type in names or is_breakable(c, g)):
                put(run)
                run = None
                enter(c, path)
            elif is_breakable(c, g) or c.size + width(run) > most:
                put(run)
                run = begun(c, path, first(c), c.end, c.size)
            else:
                s = begun(c, path, c.start, c.end, c.size)
                run = run + s if run else s
        put(run)

    enter(root, ())
    everything = frozenset(cut.classes), frozenset(cut.functions)
    cut.spans = [replace(s, classes=everything[0], functions=everything[1]) if s.import_only else s for s in cut.spans]
    return cut


def merge_spans(spans: list[Span], most: int) -> list[Span]:
    """Neighbours joined: always where they start on one line; else unless the right one stands alone or the sum is too large."""
    out: list[Span] = []
    for s in spans:
        if out and (s.start[0] == out[-1].start[0] or s.dechunk and out[-1].size + s.size <= most):
            out[-1] = out[-1] + s
        else:
            out.append(s)
    return out


def byte_spans(root: Node, most: int) -> list[tuple[int, int]]:
    """Byte spans of the structure-blind strategy: children are taken up until `most` bytes would be passed, larger ones are
    entered; each span then reaches to the next, the last to the end."""
    starts: list[int] = []

    def enter(n: Node, at: int) -> None:
        for c in n.children:
            if c.size > most:
                if at < c.start_byte:
                    starts.append(at)
                enter(c, c.start_byte)
                at = c.end_byte
            elif c.end_byte > at + most:
                if at < c.start_byte:
                    starts.append(at)
                at = c.start_byte
        if at < n.end_byte:
            starts.append(at)

    enter(root, root.start_byte)
    return [(0, root.end_byte)] if len(starts) == 1 else list(zip(starts, [*starts[1:], root.end_byte]))


def coalesced(spans: list[tuple[int, int]], data: bytes, least: int = 80) -> list[tuple[int, int]]:
    """Byte spans joined until more than `least` characters that are no white space have come together over a line end;
    what begins with a closing bracket joins the span before."""
    text = lambda a, b: data[a:b].decode("utf-8", "ignore")
    out: list[tuple[int, int]] = []
    run: tuple[int, int] | None = None
    for a, b in spans:
        both = (run[0], max(run[1], b)) if run else (a, b)
        body = text(*both)
        if out and body.strip()[:1] in (")", "}", "]"):
            out[-1] = (out[-1][0], max(out[-1][1], b))
            run = None
        elif run and "\n" in body and len(re.sub(r"\s", "", body)) > least:
            out.append(run)
            run = (a, b)
        else:
            run = both
    return out + [run] if run and run[0] < run[1] else out


def line_spans(spans: list[tuple[int, int]], data: bytes, least: int = 80) -> list[tuple[int, int]]:
    """Byte spans as inclusive rows from 0: each begins on the row after the one in which the span before ended; a last
    one of fewer rows than `least` joins the one before. Empty ones fall away."""
    ends = [0]
    for m in re.finditer(b"\n", data):
        ends.append(m.end())
    # rows by their first byte

    row = lambda at: bisect.bisect_right(ends, at) - 1
    rows = [(0 if i == 0 else row(a) + 1, row(b)) for i, (a, b) in enumerate(spans)]
    rows = [(a, b) for a, b in rows if a <= b]
    full = [(a, b) for a, b in rows if b > a]
    if len(full) > 1 and full[-1][1] - full[-1][0] < least:
        full[-2:] = [(full[-2][0], full[-1][1])]
    return full


def legacy_spans(root: Node, data: bytes, most: int, least: int = 80) -> list[tuple[int, int]]:
    """Inclusive rows of the structure-blind strategy."""
    return line_spans(coalesced(byte_spans(root, most), data, least), data, least)


def diff_pieces(text: str, limit: int, count=lambda s: len(s.split()), lines_each: int = 200, overlap: int = 15) -> list[str]:
    """A change set under the limit is one piece; else it is cut at file headers (`a/x b/x`) and every `lines_each` lines
    with an overlap, each later piece with its header again."""
    if count(text) < limit:
        return [text]
    out, header, run, fresh = [], None, [], 0
    for line in text.split("\n"):
        if re.match(r"^a/.+ b/.+$", line):
            if fresh:
                out.append("\n".join(run))
            header, run, fresh = line, [line], 1
            continue
        run.append(line)
        fresh += 1
        if len(run) >= lines_each:
            out.append("\n".join(run))
            run, fresh = ([header] if header else []) + run[-overlap:], 0
    if fresh:
        out.append("\n".join(run))
    return out


def pack_batches(sizes: list[int], target: int) -> list[list[int]]:
    """Positions in batches whose sizes sum to at most the target, in order; one that is larger alone is a batch."""
    out, run, total = [], [], 0
    for i, n in enumerate(sizes):
        if run and total + n > target:
            out.append(run)
            run, total = [], 0
        run.append(i)
        total += n
    return out + [run] if run else out


def tree_of(text: str, language: str | None) -> Node | None:
    """The text's tree; None where the language has no parser or its parser gives up."""
    parser = PARSERS.get(language or "")
    try:
        return parser(text) if parser else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def strategy_of(language: str | None, by_structure: bool = True) -> str:
    """'structure' for languages with a grammar, 'legacy' for others with a parser, 'lines' for the rest."""
    if language in GRAMMARS and by_structure:
        return "structure"
    return "legacy" if language in PARSERS else "lines"


def file_spans(text: str, language: str, most: int) -> list[Span] | None:
    """Merged spans of a file by its structure, one for each range of lines; None without a tree."""
    root = tree_of(text, language)
    if root is None:
        return None
    spans = merge_spans(tree_spans(root, GRAMMARS[language], most, text.split("\n")).spans, most)
    return list({(s.start[0], s.end[0]): s for s in reversed(spans)}.values())[::-1]


CHUNK = "start int, end int, classes array<string>, functions array<string>, import_only boolean, depth int"


def chunk_text(text: str, language: str | None, most: int = 1200, by_structure: bool = True) -> list[tuple]:
    """(start, end, classes, functions, import_only, depth) with lines from 1, inclusive: by the strategy of the language.

    Languages without a parser, and texts that their parser gives up on (Python's on invalid syntax), are cut every 50
    lines, so that no text is lost; of these windows the end is one line past, as chunk indexes have it.
    """
    how = strategy_of(language, by_structure)
    if how == "structure" and (spans := file_spans(text, language, most)) is not None:
        out = []
        for s in spans:
            classes, functions = (sorted(s.classes), sorted(s.functions)) if s.import_only else s.names
            out.append((s.start[0] + 1, s.end[0] + 1, classes, functions, s.import_only, len(s.hierarchy)))
        return out
    if how == "legacy" and (root := tree_of(text, language)) is not None:
        return [(a + 1, b + 1, [], [], False, 0) for a, b in legacy_spans(root, text.encode("utf-8", "surrogatepass"), most)]
    n = text.count("\n") + 1
    return [(a + 1, min(a + 50, n) + 1, [], [], False, 0) for a in range(0, n, 50)]


def per_text(df: DataFrame, key: str, text: str, language: str | None, fn: Callable, schema: str) -> DataFrame:
    """key and the rows that fn(text, language) gives, for every non-null text, in its task; nothing is shuffled."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ \w)", schema)]
    kept = df.select(df[key].alias(key), df[text].alias("_text"), *([df[language].alias("_lang")] if language else []))
    kept = kept.where(kept["_text"].isNotNull())

    def run(batches):
        for b in batches:
            langs = b["_lang"] if language else [None] * len(b)
            yield pd.DataFrame([(k, *r) for k, t, lang in zip(b[key], b["_text"], langs) for r in fn(t, lang)], columns=[key, *names])

    return kept.mapInPandas(run, f"`{key}` {dict(kept.dtypes)[key]}, {schema}")


def chunk_source(files: DataFrame, key: str, text: str, language: str, most: int = 1200, by_structure: bool = True) -> DataFrame:
    """key and the chunks of every non-empty text (see `chunk_text`); texts stay in their task."""
    return per_text(files, key, text, language, lambda t, lang: chunk_text(t, lang, most, by_structure) if t else [], CHUNK)


# symbols

# fixed values: node types that count as classes, functions and imports in the symbol index
SYMBOL_CLASSES = {
    "python": {"class_definition"}, "javascript": {"class_declaration", "class"}, "typescript": {"class_declaration"}, "tsx": {"class_declaration"}, "java": {"class_declaration", "interface_declaration", "enum_declaration", "record_declaration"},
    "ruby": {"class", "module"}, "kotlin": {"class_declaration", "object_declaration", "interface_declaration"}, "swift": {"class_declaration", "struct_declaration", "enum_declaration", "protocol_declaration"},
}
SYMBOL_FUNCTIONS = {
    "python": {"function_definition"}, "javascript": {"function_declaration", "method_definition", "constructor"}, "typescript": {"function_declaration", "method_definition", "method_signature", "constructor"},
    "tsx": {"function_declaration", "method_definition", "method_signature", "constructor"}, "java": {"method_declaration", "constructor_declaration"}, "ruby": {"method", "singleton_method"}, "kotlin": {"function_declaration", "secondary_constructor"},
    "swift": {"function_declaration", "initializer_declaration"},
}
SYMBOL_IMPORTS = {
    "python": {"import_statement", "import_from_statement"}, "javascript": {"import_declaration"}, "typescript": {"import_declaration"}, "tsx": {"import_declaration"}, "java": {"import_declaration"}, "ruby": set(),
    "kotlin": {"import_list", "import_header", "import_directive"}, "swift": {"import_declaration"},
}

SYMBOL = "node_name string, node_type string, category string, start_line int, end_line int, parent_name string, parent_type string"
_NO_CODE = re.compile(r"\s*(?:#|//|/\*|\*|--|\Z)")


def symbols_of(text: str, language: str | None) -> list[tuple]:
    """(name, node type, category, first line, last line, parent, parent's kind) of classes, functions and imports in the
    order of their lines. Imports with nothing but blank and comment lines between them are one block. A function's parent
    is the nearest class around it. A Python declaration begins with its decorators; the wrapper around both, and the
    decorators themselves, have no category."""
    root = tree_of(text, language)
    if root is None or language not in SYMBOL_CLASSES:
        return []
    classes, functions, imports = SYMBOL_CLASSES[language], SYMBOL_FUNCTIONS[language], SYMBOL_IMPORTS[language]
    lines, found, todo = text.split("\n"), [], [(root, None)]
    while todo:
        n, around = todo.pop()
        kind = "class" if n.type in classes else "function" if n.type in functions else "import" if n.type in imports else None
        if kind or n.type == "decorated_definition":
            name = n.name or next((c.text for c in n.children if c.type in ("identifier", "name", "type_identifier")), None) or "unnamed"
            found.append((n.start[0], len(found), name, n.type, kind, n.end[0], around if kind == "function" else None))
            if kind == "class":
                around = name
        todo += [(c, around) for c in reversed(n.children)]
    found.sort()
    out: list[list] = []
    for row, _, name, node_type, kind, last, parent in found:
        if kind == "import":
            before = out[-1] if out else None
            if before and before[2] == "import" and all(_NO_CODE.match(x) for x in lines[before[4] : row]):
                before[4] = last + 1
            else:
                out.append(["imports_block", "import_block", "import", row + 1, last + 1, None, None])
            continue
        first = row
        if language == "python" and kind:
            at = row - 1
            while at >= 0 and (lines[at].lstrip().startswith("@") or _NO_CODE.match(lines[at])):
                first = at if lines[at].lstrip().startswith("@") else first
                at -= 1
        out.append([name, node_type, kind, first + 1, last + 1, parent, "class" if parent else None])
    return [tuple(x) for x in out]


# fixed values: node types that a summary shows
SHOWN = frozenset("class_definition class_declaration class function_definition function_declaration function method_definition import_statement import_declaration import_from_statement decorator annotation interface_declaration enum_declaration struct_declaration variable_declaration const_declaration let_declaration".split())
_SIGNED = frozenset("function_definition function_declaration method_definition class_definition class_declaration".split())


def outline(text: str, language: str | None, most: int = 200, signature: int = 3) -> list[tuple[int, str]] | None:
    """(line, shown) of the declarations of a text in the order of their lines: the first line, or a signature of up to
    three lines that ends with its colon, brace or closing bracket. The first `most` found in the tree count; of those
    that begin on one line the last stays. None without a tree."""
    root = tree_of(text, language)
    if root is None:
        return None
    lines, todo, found = text.split("\n"), [root], []
    while todo and len(found) < most:
        n = todo.pop()
        if n.type in SHOWN and n.start[0] < len(lines):
            shown = lines[n.start[0]]
            if n.type in _SIGNED:
                part: list[str] = []
                for x in lines[n.start[0] : min(n.start[0] + signature, n.end[0] + 1)]:
                    part.append(x)
                    if ":" in x or "{" in x or x.strip().endswith(")") and "(" in "".join(part):
                        break
                shown = "\n".join(part)
            if shown:
                found.append((n.start[0] + 1, f"{n.start[0] + 1}: {shown}"))
        todo += reversed(n.children)
    return sorted(dict(found).items())
