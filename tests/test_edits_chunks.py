"""Edits, chunking folds, streams, store and sources."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C, edits as E, embed, store as S, trees as T
from corpusmill.sources.tree import GitSnapshot, scan_tree, with_hash
from corpusmill.streaming import events as V


def block(a, b):
    return f"--- SEARCH\n{a}\n===\n{b}\n+++ REPLACE\n"


def test_search_replace():
    t = "def f():\n    x = 1\n    y = 2\n    return x\n"
    assert E.search_replace(t, block("    x = 1", "    x = 5")) == t.replace("x = 1", "x = 5")
    assert "q = 3" in E.search_replace(t, block("x = 1\ny = 2", "q = 3"))  # shifted indent
    assert E.search_replace(t, block("def f():\nanything\nat all\n    return x", "pass")) == "pass\n"  # anchors
    assert E.search_replace(t, block("", "end = 1")).endswith("return x\nend = 1\n")
    assert E.search_replace("a\r\nb\r\n", block("a", "c")) == "c\r\nb\r\n"
    assert E.search_replace("a\nb", block("b", "c")) == "a\nc"
    near = "def compute_the_total(values):\n    return sum(values)"
    assert E.locate(["def compute_the_totals(values):", "    return sum(values)"], near.split("\n")) == (0, 2)
    for bad in (block("zzz", "y"), block("    x = 1", "    x = 1"), "--- SEARCH\nx\n===\n", block("    x = 1\n    y = 2", "a") + block("    y = 2\n    return x", "b")):
        with pytest.raises(E.EditError):
            E.search_replace(t, bad)


def test_line_numbered():
    t = "1\n2\n3\n4\n"
    assert E.line_numbered(t, [(2, 3, "x\n")]) == "1\nx\n4\n"
    assert E.line_numbered(t, [(2, 3, "x\ny")]) == "1\nx\n4\n"  # no final line end: the last line is lost
    assert E.line_numbered(t, [(2, 3, "x\n"), (3, 3, "z")]) == "1\nx\n4\nz\n"
    assert E.line_numbered(t, [(9, 9, "z\n")]) == "1\n2\n3\n4\nz\n\n"


def test_unified():
    t = "a\nb\nc\nd\n"
    assert E.unified(t, "```diff\n--- x\n+++ x\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n```") == ("a\nB\nc\nd\n", [])
    assert E.unified(t, "@@ @@\n wrong\n-b\n+B\n c")[0] == "a\nB\nc\nd\n"
    new, errors = E.unified(t, "@@ @@\n-zzz\n+y")
    assert new == t and len(errors) == 1
    assert E.unified("", "@@ @@\n+new")[0] == "new\n"


def test_normalised_hunks():
    h = [" a", "-b", "+c", " d"]
    assert E.normalised(h) == h and E.normalised([" a", " b"]) == [] and E.normalised(["-x", "+x"]) == []
    assert E.normalised(["-b", "+c", " d", "   "]) == ["-b", "+c", " d", " "]
    assert E.distinct_hunks([h, list(h), [" same"], ["+n"]]) == [h, ["+n"]]


def test_relative_indents():
    for t in ("a\n  b\n    c\n\n  d\ne\n", "\tx\n  y\n", "", "   \n a"):
        assert E.absolute(E.relative(t)) == t
    text = "class A:\n    def f(self):\n        x = 1\n        y = 2\n    z = 3\n"
    assert E.flexible_replace(text, "        x = 1\n        y = 2\n", "        q = 0\n") == text.replace("        x = 1\n        y = 2\n", "        q = 0\n")
    assert E.flexible_replace(text, "\n\n        x = 1\n", "        q = 0\n") == text.replace("x = 1", "q = 0")
    want = text.replace("x = 1", "q = 0").replace("y = 2", "w = 1")
    assert E.flexible_replace(text, "    x = 1\n    y = 2\n", "    q = 0\n    w = 1\n") == want  # only the indents between lines count
    assert E.flexible_replace(text, "nothing of it\n", "x\n") is None and E.flexible_replace(text, "\n", "x") is None


def test_line_numbered_runner():
    assert E.RUNNERS["line_numbered"]("a\nb\n", '[[1, 1, "x\\n"]]') == ("x\nb\n", [])
    with pytest.raises(E.EditError):
        E.RUNNERS["line_numbered"]("a\n", "no json")


def test_apply_edits(spark):
    rows = [("p", "a\nb\n", "search_and_replace", block("a", "z")), ("q", None, "unified", None), ("r", "a", "nothing", "")]
    got = {r[0]: (r[1], r[2]) for r in E.apply_edits(spark.createDataFrame(rows, "file_path string, content string, kind string, diff string")).collect()}
    assert got["p"] == ("z\nb\n", None) and got["q"][0] == "" and got["r"][0] == "a" and got["r"][1]


SOURCE = 'import os\nimport re\n\n\nclass Calculator:\n    """Doc."""\n\n    def add(self, a, b):\n        return a + b\n\n    def sub(self, a, b):\n        return a - b\n\n\ndef main():\n    return Calculator().add(1, 2)\n'


@pytest.mark.parametrize("most", [60, 80, 150, 5000])
def test_tree_spans(most):
    cut = C.tree_spans(T.python_tree(SOURCE), T.GRAMMARS["python"], most, SOURCE.split("\n"))
    spans = C.merge_spans(cut.spans, most)
    lines = {i for s in spans for i in range(s.start[0], s.end[0] + 1)}
    assert {i for i, x in enumerate(SOURCE.split("\n")) if x.strip()} <= lines
    assert set(cut.classes) == {"Calculator"} and set(cut.functions) >= ({"add", "sub", "main"} if most < 150 else {"main"})
    assert {n for s in spans for n in s.names[1]} == {"add", "sub", "main"}
    assert spans[0].import_only == (most < 5000) or spans[0].functions


def leaf(kind, a, b, start, end, name=None, children=()):
    return T.Node(kind, start, end, a, b, name, name or "", list(children))


# trees of a small calculator in three languages: type, bytes, points
CALC_PY = leaf("module", 0, 290, (0, 0), (14, 25), None, [
    leaf("class_definition", 0, 210, (0, 0), (10, 20), "Calculator", [
        leaf("identifier", 0, 100, (0, 0), (10, 0), "Calculator"), leaf("function_definition", 20, 50, (1, 4), (2, 25), "__init__"), leaf("function_definition", 70, 130, (4, 4), (6, 20), "add"),
        leaf("function_definition", 150, 210, (8, 4), (10, 20), "multiply")]),
    leaf("function_definition", 230, 290, (12, 0), (14, 25), "standalone_function")])
CALC_JAVA = leaf("program", 0, 350, (0, 0), (18, 1), None, [
    leaf("class_declaration", 0, 280, (0, 0), (14, 1), "Calculator", [
        leaf("identifier", 0, 100, (0, 0), (10, 0), "Calculator"), leaf("constructor_declaration", 60, 100, (3, 4), (5, 5), "Calculator"), leaf("method_declaration", 120, 180, (7, 4), (9, 5), "add"),
        leaf("method_declaration", 200, 260, (11, 4), (13, 5), "multiply")]),
    leaf("interface_declaration", 300, 350, (16, 0), (18, 1), "MathOperations")])
CALC_JS = leaf("program", 0, 400, (0, 0), (20, 1), None, [
    leaf("class_declaration", 0, 230, (0, 0), (12, 1), "Calculator", [
        leaf("identifier", 0, 100, (0, 0), (10, 0), "Calculator"), leaf("method_definition", 25, 70, (1, 4), (3, 5), "constructor"), leaf("method_definition", 90, 140, (5, 4), (7, 5), "add"),
        leaf("method_definition", 160, 210, (9, 4), (11, 5), "multiply")]),
    leaf("function_declaration", 250, 300, (14, 0), (16, 1), "standaloneFunction")])
LINES = {
    "python": 'class Calculator:\n    def __init__(self):\n        self.result = 0\n    \n    def add(self, x, y):\n        """Add two numbers."""\n        return x + y\n    \n    def multiply(self, x, y):\n        """Multiply two numbers."""\n        return x * y\n\ndef standalone_function():\n    """A standalone function."""\n    return "Hello World"',
    "java": "public class Calculator {\n    private int result;\n    \n    public Calculator() {\n        this.result = 0;\n    }\n    \n    public int add(int x, int y) {\n        return x + y;\n    }\n    \n    public int multiply(int x, int y) {\n        return x * y;\n    }\n}\n\ninterface MathOperations {\n    int calculate(int a, int b);\n}",
    "javascript": 'class Calculator {\n    constructor() {\n        this.result = 0;\n    }\n    \n    add(x, y) {\n        return x + y;\n    }\n    \n    multiply(x, y) {\n        return x * y;\n    }\n}\n\nfunction standaloneFunction() {\n    return "Hello World";\n}\n\nconst arrowFunction = (x, y) => {\n    return x + y;\n};',
}


@pytest.mark.parametrize(
    "language,tree,most,spans,classes,functions",
    [
        ("python", CALC_PY, 80, 4, 2, 4), ("java", CALC_JAVA, 80, 4, 3, 3), ("javascript", CALC_JS, 80, 4, 2, 0), ("python", CALC_PY, 60, 4, None, None), ("java", CALC_JAVA, 70, 4, None, None),
        ("javascript", CALC_JS, 65, 4, None, None), ("python", CALC_PY, 100, 5, 2, 4),
    ],
)
def test_spans_of_known_trees(language, tree, most, spans, classes, functions):
    cut = C.tree_spans(tree, T.GRAMMARS[language], most, LINES[language].split("\n"))
    assert len(cut.spans) == spans
    if classes is not None:
        assert (len(cut.classes), len(cut.functions)) == (classes, functions)


def test_names_of_known_trees():
    simple = leaf("program", 0, 150, (0, 0), (8, 1), None, [
        leaf("class_declaration", 0, 90, (0, 0), (4, 1), "Simple", [leaf("identifier", 0, 100, (0, 0), (10, 0), "Simple"), leaf("method_declaration", 25, 80, (1, 4), (3, 5), "method")]),
        leaf("interface_declaration", 110, 150, (6, 0), (8, 1), "ISimple")])
    text = "public class Simple {\n    public int method() {\n        return 1;\n    }\n}\n\ninterface ISimple {\n    int getValue();\n}"
    cut = C.tree_spans(simple, T.GRAMMARS["java"], 50, text.split("\n"))
    assert (len(cut.spans), cut.classes, cut.functions) == (1, ["Simple", "Simple", "ISimple"], ["method", "method"])
    many = leaf("module", 0, 2000, (0, 0), (100, 0), None, [leaf("function_definition", i * 100, i * 100 + 100, (i * 5, 0), (i * 5 + 3, 0), f"f{i}") for i in range(20)])
    cut = C.tree_spans(many, T.GRAMMARS["python"], 150, ["# Large source file"] * 100)
    assert len(cut.functions) == 20 and cut.spans


SOURCES = {
    "java": 'package a.b;\nimport java.util.List;\n\n/** doc */\n@Deprecated\npublic class Calc<T> extends B {\n  private int x = 1;\n  int[] v = {1, 2};\n  public Calc() {\n    this.x = 0;\n  }\n  @Override public <X> int add(int a, int b) throws E {\n    if (a > b) { return a; } else { return b; }\n    Runnable r = () -> { g(); };\n    return a + b;\n  }\n  enum K { A, B(1) { void q() {} }; int w; void m() {} }\n}\ninterface I { int calc(int a); }\n',
    "typescript": 'import { a } from "./a";\nimport b from "b"\n\nexport interface E {\n  a: string;\n  f(x: number): void;\n}\nexport default class A<T> extends B implements E {\n  private m: Map<string, number> = new Map();\n  constructor(private a: string) { super() }\n  @dec() async f(x: number): Promise<void> {\n    if (x) { y() } else { w(`{${x}`) }\n  }\n}\nnamespace N { export function q() {} }\nexport const arrow = (x) => {\n  return x\n}\nfunction* gen() { yield 1 }\nconst re = /[{]/g, o = { a: 1 };\n',
    "kotlin": 'package a.b\n\nimport a.c.*\nimport d.e\n\ndata class A(val x: Int, private var y: String? = null) : B(x), C {\n    val z: List<Int> by lazy { listOf(1, 2) }\n    override fun f(a: Int): Any {\n        return when (a) {\n            1, 2 -> "x"\n            else -> "n"\n        }\n    }\n    companion object { const val K = 1 }\n}\ninterface M {\n    fun add(x: Int): Int\n    fun mul(x: Int): Int\n}\nobject O\nfun String.ext(): Int { return 1 }\n',
    "swift": "import Foundation\n\nprotocol P {\n  func a() -> Int\n}\n@objc public final class V: NSObject, P {\n  var y: Int { return 2 }\n  init(a: Int) { self.z = a }\n  func a() -> Int {\n    guard let q = x else { return 0 }\n    return items.map { $0 + 1 }.count\n  }\n  class func st() {}\n}\nextension V { func more() {} }\nstruct S { var k: Int }\n",
    "ruby": "require 'x'\n\n# doc\nmodule M\n  class A < B\n    attr_reader :a\n\n    def initialize(x, y = nil)\n      @a = x if y.nil?\n      z.each do |v|\n        next unless v\n      end\n      while x < 3 do\n        x += 1\n      end\n    end\n\n    def self.make(n) = new(n)\n\n    def self.std\n      <<~SQL\n        end def\n      SQL\n    end\n  end\nend\n",
    "python": SOURCE,
}
NAMES = {
    "java": ([("class", "Calc"), ("function", "Calc"), ("function", "add"), ("class", "K"), ("function", "q"), ("function", "m"), ("class", "I"), ("function", "calc")]),
    "typescript": ([("class", "A"), ("function", "constructor"), ("function", "f"), ("internal_module", "N"), ("function", "q"), ("function", "gen")]),
    "kotlin": ([("class", "A"), ("function", "f"), ("class", "M"), ("function", "add"), ("function", "mul"), ("class", "O"), ("function", "ext")]),
    "swift": ([("class", "P"), ("function", "a"), ("class", "V"), ("function", "init"), ("function", "a"), ("function", "st"), ("class", "V"), ("function", "more"), ("class", "S")]),
    "ruby": ([("module", "M"), ("class", "A"), ("function", "initialize"), ("function", "make"), ("function", "std")]),
    "python": ([("class", "Calculator"), ("function", "add"), ("function", "sub"), ("function", "main")]),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_trees(language):
    """Names in the order of the text, every line of code in some span, nodes within their parents; broken texts give trees."""
    text, g = SOURCES[language], T.GRAMMARS[language]
    root = T.PARSERS[language](text)
    assert C.mentions(root, g) == NAMES[language]
    todo = [root]
    while todo:
        n = todo.pop()
        at = n.start_byte
        for c in n.children:
            assert c.type.endswith("identifier") or at <= c.start_byte <= c.end_byte <= n.end_byte, (n.type, c.type)
            at = c.start_byte if not c.type.endswith("identifier") else at
        todo += n.children
    for most in (40, 120, 1200):
        spans = C.file_spans(text, language, most)
        rows = {i for s in spans for i in range(s.start[0], s.end[0] + 1)}
        assert {i for i, x in enumerate(text.split("\n")) if x.strip()} <= rows
        legacy = C.legacy_spans(root, text.encode(), most, 10)
        assert all(a < b for a, b in legacy) and all(y[0] > x[0] for x, y in zip(legacy, legacy[1:]))
    if language != "python":
        for cut in range(0, len(text), 7):
            T.PARSERS[language](text[:cut] + "}" * (cut % 3))


def test_script_trees_know_declared_names():
    text = "const f = () => {\n  return 1\n}\nclass A { m() {} }\nlet x = 1\n"
    assert C.mentions(T.PARSERS["javascript"](text), T.GRAMMARS["javascript"]) == [("function", "f"), ("class", "A"), ("function", "m"), ("function", "x")]


def test_symbols_and_outline():
    text = "import os\n# c\nimport re\n\n@dec\n# why\nclass A:\n    def f(self,\n          x):\n        pass\n\n    @property\n    def g(self): return 1\n"
    got = C.symbols_of(text, "python")
    assert got[0] == ("imports_block", "import_block", "import", 1, 3, None, None)
    assert ("A", "class_definition", "class", 5, 13, None, None) in got and ("f", "function_definition", "function", 8, 10, "A", "class") in got and ("g", "function_definition", "function", 12, 13, "A", "class") in got
    shown = dict(C.outline(text, "python"))
    assert shown[7] == "7: class A:" and shown[8] == "8:     def f(self,\n          x):" and shown[1] == "1: import os" and shown[5] == "5: @dec"
    assert C.outline("x", "none") is None and C.symbols_of("x = (", "python") == []
    java = C.symbols_of(SOURCES["java"], "java")
    assert [(x[0], x[2], x[5]) for x in java if x[2] == "function"] == [("Calc", "function", "Calc"), ("add", "function", "Calc"), ("q", "function", "K"), ("m", "function", "K"), ("calc", "function", "I")]


def test_folds():
    a, b = C.Span((1, 0), (2, 9), 10, (("c", "A"),)), C.Span((3, 0), (4, 9), 5, (("c", "A"), ("f", "g")), dechunk=False)
    assert (a + b).hierarchy == (("c", "A"), ("f", "g")) and (a + b).size == 15 and not (a + b).dechunk
    assert C.merge_spans([a, b], 100) == [a, b] and C.merge_spans([], 5) == []
    assert len(C.merge_spans([a, C.Span((1, 4), (9, 9), 999)], 5)) == 1
    assert C.pack_batches([5, 5, 20, 1], 10) == [[0, 1], [2], [3]]
    assert C.diff_pieces("short", 10) == ["short"]
    many = C.diff_pieces("a/x b/x\n" + "\n".join(f"l{i}" for i in range(450)), 10)
    assert len(many) == 3 and all(p.startswith("a/x b/x") for p in many) and many[1].split("\n")[1] == "l184"
    data = ("x" * 90 + "\n").encode() + b")\n" + ("y" * 90 + "\n").encode() + b"z\n"
    assert C.coalesced([(0, 91), (91, 93), (93, 184), (184, 186)], data) == [(0, 184), (184, 186)]
    assert C.coalesced([(0, 91)], data) == [(0, 91)] and C.coalesced([], data) == []
    assert C.line_spans([(0, 30), (30, 60)], b"a\n" * 30, 1) == [(0, 15), (16, 30)] and C.line_spans([(0, 30), (30, 60)], b"a\n" * 30, 99) == [(0, 30)]


def test_chunk_source(spark):
    df = spark.createDataFrame([(1, SOURCE, "python"), (2, "def (", "python"), (3, "x\n" * 120, "go"), (4, None, None), (5, "", "go")], "id int, text string, lang string")
    got = C.chunk_source(df, "id", "text", "lang").collect()
    assert [(r["start"], r["end"]) for r in got if r["id"] == 3] == [(1, 51), (51, 101), (101, 122)]
    assert {r["id"] for r in got} == {1, 2, 3}


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, t string")
    got = {r[0]: np.array(r[1]) for r in embed.embed(df, "id", "t").collect()}
    assert np.allclose(got[1], got[3]) and not got[2].any()
    calls = []

    def flaky(x):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return x

    assert embed.with_retries(flaky, sleep=lambda s: None)(4) == 4
    with pytest.raises(OSError):
        embed.with_retries(lambda x: (_ for _ in ()).throw(OSError()), tries=2, sleep=lambda s: None)(1)


def test_store(spark, tmp_path):
    repo = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", "4")], "p string, h string")
    db = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "5"), ("n", None)], "p string, h string")
    assert {tuple(r) for r in S.diff(repo, db, ["p"], "h").collect()} == {("a", "insert"), ("c", "update"), ("d", "delete"), ("n", "insert")}
    got = S.numbered(spark.createDataFrame([(x,) for x in "hgfedcba"], "k string"), ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 9))
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("b", 2)], "p string, t int")
    assert [r["p"] for r in S.complete_files(rows, "p", "t").collect()] == []
    folder = str(tmp_path / "s")
    assert S.ensure_schema(spark, folder, 19, lambda: repo) and not S.ensure_schema(spark, folder, 19, lambda: repo) and S.ensure_schema(spark, folder, 20, lambda: repo)
    assert S.schema_version(spark, folder) == 20
    assert {tuple(r) for r in S.latest(db.withColumn("v", F.lit(1)), ["p"], "v").select("p", "h").collect()} == {tuple(r) for r in db.collect()}


def test_sources(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "d").mkdir(parents=True)
    (repo / "d/a.txt").write_text("hello")
    g = lambda *a: subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True)
    g("init"), g("add", "."), g("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-m", "m")
    spark.dataSource.register(GitSnapshot)
    got = spark.read.format("git_snapshot").load(str(repo)).collect()
    assert [(r["file_path"], r["file_hash"]) for r in got] == [("d/a.txt", "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0")]
    assert with_hash(scan_tree(spark, str(repo / "d"))).first()["file_hash"] == "26c7827d889f6da3"


EVENTS = [("s", 1, "delta", 1.0), ("s", 2, "start", None), ("s", 3, "delta", 2.0), ("s", 4, "start", None), ("s", 5, "delta", 3.0), ("s", 6, "delta", None), ("s", 7, "end", None), ("s", 8, "end", None), ("t", 1, "start", None), ("t", 2, "delta", 9.0)]


def test_fold_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "stream string, seq int, kind string, value double")
    k = F.col("kind")
    batch = V.fold_blocks(df, "stream", ["seq"], k == "start", k == "delta", k == "end", "value").collect()
    assert [tuple(r) for r in batch] == [("s", 2, 2, 3.0)]
    for i in range(0, len(EVENTS), 3):
        spark.createDataFrame(EVENTS[i : i + 3], df.schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = V.fold_blocks_stream(src, "stream", "seq").writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table("folded").collect()]
    assert got == [("s", 2, 2, 3.0)]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_tag_parser(cut):
    text = "pre <a>one < two</a> mid <x> <b></b>end<"
    p, out = V.TagParser({"a", "b"}), []
    for i in range(0, len(text), cut):
        out += p.feed(text[i : i + cut])
    out += p.close()
    merged = {}
    for tag, s in out:
        merged[tag] = merged.get(tag, "") + s
    assert merged == {None: "pre  mid <x> end<", "a": "one < two"}
