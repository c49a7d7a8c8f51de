"""Hand-written or not, valid or not."""

import pytest

from corpusmill.llm import handwritten as H, validity as V

OWN = "class A:\n    def f(self):\n        return 1\n"


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("src/a.py", OWN, None),
        ("src/a.py", "# Code generated by tool. DO NOT EDIT.\n" + OWN, "generated"),
        ("src/a.go", "// Fichier produit par outil, ne pas modifier.\npackage x\n", "generated"),
        ("src/a.kt", "// Automatisch erzeugt aus x.json - bitte nicht von Hand ändern.\nclass A\n", "generated"),
        ("src/a.py", "# Do not edit the constants below without telling team x.\n" + OWN, None),
        ("src/a.py", "# This script generates the client; its output lands under gen/.\n" + OWN, None),
        ("src/a.py", OWN + '\nHEAD = "# Code generated by x. DO NOT EDIT."\n', None),
        ("src/a.py", "# Copyright (c) 2024 the project authors. All rights reserved.\n" + OWN, None),
        ("src/a.js", "/*! thing 1.2.3 */\nvar a=1\n", "vendored"),
        ("vendor/lib/a.py", OWN, "vendored"),
        ("src/vendor_portal/a.py", OWN, None),
        ("distance/a.py", OWN, None),
        ("src/x.min.js", "var a=1;" * 60, "minified"),
        ("src/x.py", "a=lambda x:x+1;b=[i for i in range(3)if i];" * 20, "minified"),
        ("src/x.py", 'QUERY = "SELECT ' + "column_name, " * 60 + '"\n' + OWN, None),
        ("src/x.js", "const d = [\n" + "  0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07,\n" * 40 + "];\n", "data"),
        ("src/x.rb", "class P\n" + "".join(f"  def f{i}\n    @f{i}\n  end\n" for i in range(30)) + "end\n", "generated"),
        ("a/package-lock.json", "{}", "lockfile"),
        ("a.py", "", None), ("a.py", None, None), ("a.py", "   \n", None),
    ],
)
def test_kind(path, text, kind):
    assert H.classify(path, text)[0] == kind


NOTICE = "# Code generated by x. DO NOT EDIT.\n"


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("src/a.py", OWN + "\n" + NOTICE, "generated"),
        ("src/a.js", "f();\n\n// Fichier produit par span-codegen, ne pas modifier.\n// eslint-disable\n\n", "generated"),
        ("src/a.js", "f();\n/*\n  <auto-generated>\n  by x\n*/\n", "generated"),
        ("src/a.kt", "package a.b\n\n// AUTOGENERATED FROM outline.proto\n\nclass A\n", "generated"),
        ("src/a.kt", "package a.b\n\n// Writes the line '// AUTOGENERATED FROM x'.\nclass A\n", None),
        ("src/a.py", "# a licence\n" * 60 + NOTICE + OWN, "generated"),
        ("src/a.py", "# " + "a licence " * 600 + "\n" + NOTICE + OWN, "generated"),
        ("src/a.py", OWN + "    # emits files that start with '@generated'\n", None),
        ("src/a.rb", "def f\n  g\n  # emits files that start with '@generated'\n  h\nend\n", None),
        ("src/a.py", OWN + 'HEAD = """\n' + NOTICE + '"""\n', None),
        ("src/a.py", OWN + 'HEAD = """\n' + NOTICE + '#"""\n', None),
        ("src/a.js", "const h = `\n// Code generated by x.\n// y`\n", None),
        ("src/a.py", "# written by hand\n" + OWN + NOTICE, None),
    ],
)
def test_place_of_the_notice(path, text, kind):
    assert H.classify(path, text)[0] == kind


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("src/deps/resolver.py", OWN, None), ("app/external/api.py", OWN, None), ("contrib/tool/run.py", OWN, None), ("deps/lib-1.2.3/a.py", OWN, "vendored"), ("lib/jquery.min.js", "function f(a) {\n  return a;\n}\n", "minified"),
        ("a/b.py", "# licence\n" * 300 + NOTICE + OWN, "generated"), ("a/b.py", "# " + "x" * 9000 + "\n" + NOTICE + OWN, "generated"),
    ],
)
def test_paths_and_long_heads(path, text, kind):
    assert H.classify(path, text)[0] == kind


def test_libraries(spark):
    """Folders that may be third-party: so if the library is vendored elsewhere, or the body is a copy, also a short one."""
    short = "class LongEnoughName:\n    def method_with_a_name(self):\n        return self.compute_something_else(1)\n"
    rows = [(1, "r", "vendor/zlib-9/a.py", OWN), (2, "q", "external/zlib-9/b.py", "x = 1\n"), (3, "q", "external/own/b.py", "y = 1\n"), (4, "q", "src/external/c.py", "z = 1\n"), (5, "r", "vendor/k/s.py", short), (6, "q", "src/s.py", short), (7, "q", "external/zlib-9/e.py", " "), (None, "q", "src/own.py", "z = 2\n")]
    df = spark.createDataFrame(rows, "file_id bigint, repo_path string, file_path string, content string")
    assert {r["file_id"] for r in H.not_hand_written(df).collect()} == {1, 2, 5, 6}


def test_copies(spark):
    body = "".join(f"def f_{c}(a):\n    return a\n" for c in "abcdefghijklmnopq")
    rows = [(1, "r", "vendor/l/a.py", "# lib v1.2.3\n" + body, "x"), (2, "r", "src/a.py", body, "x"), (2, "r", "src/a.py", body, "x"), (3, "r", "src/b.py", body + "x = 1\n", "x"), (4, None, None, None, "x"), (5, "r", "s.py", "", "x")]
    df = spark.createDataFrame(rows, "file_id bigint, repo_path string, file_path string, content string, kind string")
    got = {r["file_id"]: r["reason"] for r in H.not_hand_written(df).collect()}
    assert got == {1: "path", 2: "copy of a vendored file"} and H.not_hand_written(df.limit(0)).count() == 0


GOOD = {
    "javascript": "import { a } from './a';\nconst p = /[{(]+\\s*$/;\nclass A extends B {\n  static async f(x, { y } = {}, ...z) {\n    for (const k of z) { if (k) return k ? 1 : y; else continue }\n    return `t ${x + 1} {`;\n  }\n  get v() { return this.x?.y ?? null }\n}\nexport default A;\n",
    "typescript": "interface E {\n  a: string;\n  b?: number[];\n}\ntype U = E | null;\nexport class A<T> implements E {\n  private readonly m: Map<string, Array<T>> = new Map();\n  constructor(private a: string, public b?: number) {}\n  async f(x: number, ...y: string[]): Promise<void> { const z: unknown = x as any; }\n}\nenum K { A = 1, B }\n",
    "java": "package a.b;\n\nimport java.util.*;\n\n@Deprecated\npublic class A<T> extends B implements C, D {\n  private final int[] v = {1, 2};\n  @Override public <X> int f(int a, final String... b) throws E {\n    for (var x : b) { if (a > 1 && x != null) continue; else a++; }\n    try { g((int) 1.5); } catch (IOException | RuntimeException e) { throw e; } finally { }\n    Runnable r = () -> { }; return a == 1 ? 2 : 3;\n  }\n  enum K { A, B; int z; }\n}\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\tC []map[string]*T\n}\n\ntype I interface {\n\tF(a int) (int, error)\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tfor i, v := range b {\n\t\tif v == \"\" || i > 2 {\n\t\t\tcontinue\n\t\t} else if x := f(v); x != nil {\n\t\t\treturn 0, x\n\t\t}\n\t}\n\tswitch a {\n\tcase 1, 2:\n\t\tgo func() { fmt.Println(T{A: 1}) }()\n\tdefault:\n\t}\n\treturn []int{1, 2}[0], nil\n}\n",
    "kotlin": "package a.b\n\nimport a.c.*\n\n/* outer /* inner */ still */\ndata class A(val x: Int, private var y: String? = null) : B(x), C {\n    val z: List<Int> by lazy { listOf(1, 2) }\n    override fun f(a: Int): Any {\n        for (i in 0 until a) { if (i > 2) return i else g(i) }\n        val s = \"v ${x + 1} {\"\n        return when (a) {\n            1, 2 -> \"x\"\n            else -> s ?: \"none\"\n        }\n    }\n    companion object { const val K = 1 }\n}\n",
    "ruby": "require 'x'\n\nmodule M\n  class A < B\n    attr_reader :a, :b\n\n    def f(x, y = nil, *z, &blk)\n      return x if y.nil?\n      z.each do |v|\n        next unless v\n        puts \"v #{v + 1} {\" if v > 1\n      end\n      h = { a: 1, 'b' => 2 }\n      while x < 3 do\n        x += 1\n      end\n      case x\n      when 1, 2 then foo\n      else bar(h)\n      end\n    rescue StandardError => e\n      raise e\n    end\n  end\nend\n",
    "python": "def f(a, *, b: int = 1) -> None:\n    match a:\n        case 1:\n            return f'{b}'\n",
    "json": '{"a": [1, 2]}',
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_grammars(language):
    text = GOOD[language]
    assert V.judge(text, language) == ("valid", language)
    assert V.judge("\ufeff" + text.replace("\n", "\r\n"), language)[0] == "valid"
    assert V.judge("", language)[0] == "valid" and V.judge(None, language)[0] == "unknown"
    assert V.judge(text[: len(text) * 2 // 3], language)[0] == "corrupt"
    cut = text.split("\n")
    mid = len(cut) // 2
    conflict = "\n".join([*cut[:mid], "<<<<<<< HEAD", cut[mid], "=======", cut[mid], ">>>>>>> 1a2b3c4d (other)", *cut[mid + 1 :]])
    if language != "json":
        assert V.judge(conflict, language)[0] == "corrupt"
    assert V.judge(text + "\0", language)[0] == "corrupt"
    if language != "json":
        assert V.judge("<!DOCTYPE html>\n<html><body>404</body></html>\n", language)[0] == "corrupt"
    for other, foreign in GOOD.items():
        if other not in (language, "json") and (other, language) != ("javascript", "typescript"):
            assert V.judge(foreign, language) in (("wrong extension", other), ("wrong extension", "typescript")), (other, language)


def test_words_in_strings_and_comments_are_fine():
    assert V.judge("/* How to resolve:\n<<<<<<< ours\n=======\n>>>>>>> theirs\n*/\nlet a = '<<<<<<<';\n", "javascript")[0] == "valid"
    assert V.judge("// TODO (it's {unfinished)\npackage a\n", "go")[0] == "valid"
    assert V.judge("# (it's {unfinished)\nx = 1\n", "ruby")[0] == "valid"


def test_files(spark):
    rows = [(1, "r", "a.py", "x = (", 0), (1, "r", "a.py", "x = (", 0), (2, "r", "run", "x = 1", 0), (3, "r", "go", "x = 1", 0), (4, "r", "none", "x = (", 0), (5, None, None, None, 0), (6, "r", "b.js", GOOD["java"], 0), (7, "r", "c.xyz", "((", 0), (8, "r", "d.go", "", 0)]
    repo = spark.createDataFrame(rows, "file_id bigint, repo_path string, file_path string, content string, language int")
    files = spark.createDataFrame([(2, "Python"), (2, "Python"), (3, " golang"), (4, None)], "id bigint, language string")
    got = {r["file_id"]: (r["language"], r["verdict"], r["found"]) for r in V.invalid_files(repo, files).collect()}
    assert got == {1: ("python", "corrupt", None), 3: ("go", "wrong extension", "python"), 6: ("javascript", "wrong extension", "java")} or got[3][1] == "wrong extension" and set(got) == {1, 3, 6}
    rates = {(r["repo_path"], r["language"]): (r["n_files"], r["rate"]) for r in V.invalid_rates(repo, files).collect()}
    assert rates[("r", "python")] == (2, 0.5) and rates[("r", "go")] == (2, 0.5)
    assert V.invalid_files(repo.limit(0), files.limit(0)).count() == 0


@pytest.mark.parametrize("language", ["python", "javascript", "ruby"])
def test_json_under_other_names(language):
    """Valid syntax there, so no case, but known as another language."""
    for text in ('{"name": "x", "version": 1}\n', '[\n  {"a": 1.5, "b": ["c"]}\n]\n'):
        verdict, found = V.judge(text, language)
        assert found == "json" and (verdict == "suspect" or language != "python" and verdict == "wrong extension")
    assert V.judge("x = [1, 2]\n", language) == ("valid", language) and V.judge("", language) == ("valid", language)


def test_too_deep():
    assert V.judge("{" * 200_000, "json") == ("corrupt", None) and V.judge("[" * 200_000 + "]" * 200_000, "json") == ("valid", "json")
    assert V.judge("(" * 200_000, "python")[0] != "valid" and V.judge("x = " + "-" * 200_000 + "1", "python")[0] in ("unknown", "corrupt")


def test_nested_json_parser_against_the_library():
    import json
    import random

    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(['{', '}', '[', ']', ',', ':', '"a"', '1', 'null', ' ']) for _ in range(r.randint(1, 9)))
        if r.random() < 0.4:
            t = json.dumps(r.choice([{"a": [1, {"b": None}], "c": "\\u1"}, [], {}, [[[]]], "x", -1.5e3]), indent=r.choice([None, 1]))
        try:
            json.loads(t)
            want = True
        except ValueError:
            want = False
        assert V.json_nested(t) == want, t
