"""Source files that do not parse.

A file's language is the one its extension stands for, or, without an extension, the declared one. The languages are
ranked by how many of the text's words are theirs, and the text is parsed against their grammars until those left cannot
change the verdict: where its own language fails, in the order of the ranking until one succeeds - a successful foreign
parse says that the extension is wrong, failure everywhere that the file is corrupt; where its own language succeeds,
against those that rank clearly above it, so that a JSON object under the name of a script is known as such although it
is valid syntax there (`suspect`; such a file is not invalid).

Python's own parser serves for Python; the other grammars are in `syntax`. Only syntax counts. Byte-order marks and any
line ends are fine, as are empty files and files of comments; NUL characters are not. Where a parser gives up because a
text is nested too deeply, the verdict is 'unknown'.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions.paths import extension
from corpusmill.session import spread

EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".java": "java", ".go": "go", ".kt": "kotlin",
    ".kts": "kotlin", ".rb": "ruby", ".rake": "ruby", ".json": "json",
}
ALIASES = {
    "py": "python", "python": "python", "python3": "python", "js": "javascript", "javascript": "javascript", "node": "javascript", "ecmascript": "javascript", "ts": "typescript", "typescript": "typescript", "java": "java", "go": "go",
    "golang": "go", "kt": "kotlin", "kotlin": "kotlin", "rb": "ruby", "ruby": "ruby", "json": "json",
}
#: Words that count for a language when foreign grammars are ranked.
HINTS = {
    "python": "def elif None True False self import from lambda except pass", "javascript": "const let var function require module exports => ===", "typescript": "interface readonly export const string number => unknown",
    "java": "public private static final void class package extends new int String", "go": "func package import := struct range nil err defer", "kotlin": "fun val var internal override data package when", "ruby": "end def do attr_reader require nil elsif unless puts",
    "json": "",
}
_WORD = re.compile(r"[A-Za-z_]\w*|:=|=>|===")


class _Python:
    def valid(self, text: str) -> bool | None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
                return True
            except (SyntaxError, ValueError):
                return False
            except (RecursionError, MemoryError):
                return None  # too deep for the parser, which says nothing about the syntax


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))')


def json_nested(text: str) -> bool:
    """Whether a text is JSON, with a stack of its own: for texts too deep for the recursive parser."""
    at, n, stack, want = 0, len(text.rstrip(" \t\n\r")), [], "value"  # what may come next
    while at < n:
        m = _JSON_TOKEN.match(text, at)
        if m is None or want == "end":
            return False
        at = m.end()
        mark, string, _ = m.groups()
        if mark is None:
            if want in ("key", "key or }"):
                if string is None:
                    return False
                want = ":"
            elif want in ("value", "value or ]"):
                want = "next" if stack else "end"
            else:
                return False
        elif mark in "{[":
            if want not in ("value", "value or ]"):
                return False
            stack.append(mark)
            want = "key or }" if mark == "{" else "value or ]"
        elif mark in "}]":
            if not stack or stack.pop() != {"}": "{", "]": "["}[mark] or want not in ("next", {"}": "key or }", "]": "value or ]"}[mark]):
                return False
            want = "next" if stack else "end"
        elif mark == ",":
            if want != "next":
                return False
            want = "key" if stack[-1] == "{" else "value"
        else:
            if want != ":":
                return False
            want = "value"
    return want == "end"


class _Json:
    def valid(self, text: str) -> bool:
        try:
            json.loads(text)
            return True
        except RecursionError:
            return json_nested(text)
        except ValueError:
            return not text.strip()


_grammars: dict = {}


def grammar(language: str):
    """The language's grammar, made once per worker process."""
    if not _grammars:
        from .syntax.go import Go
        from .syntax.java import Java
        from .syntax.kotlin import Kotlin
        from .syntax.ruby import Ruby
        from .syntax.script import Script, Typed

        _grammars.update(python=_Python(), json=_Json(), javascript=Script(), typescript=Typed(), java=Java(), go=Go(), kotlin=Kotlin(), ruby=Ruby())
    return _grammars[language]


_WORD_OF: dict[str, list[str]] = {}
for _k, _v in HINTS.items():
    for _w in set(_v.split()):
        _WORD_OF.setdefault(_w, []).append(_k)


def scores(text: str) -> dict[str, int]:
    """How many of a text's words are each language's. An object or list of strings and numbers speaks for JSON."""
    out = dict.fromkeys(HINTS, 0)
    for w, n in Counter(_WORD.findall(text)).items():
        for k in _WORD_OF.get(w, ()):
            out[k] += n
    head = text.lstrip()
    if head[:1] in ("{", "[") and _JSON_HEAD.match(head):
        out["json"] = max(out.values()) + 3
    return out


def rank(text: str) -> list[str]:
    """Languages by how many of a text's words are theirs, the likeliest first."""
    score = scores(text)
    return sorted(score, key=lambda k: (-score[k], k))


#: A language contains another: what is valid in the second says nothing against the first.
_CONTAINS = {("typescript", "javascript")}
_JSON_HEAD = re.compile(r'\{\s*(?:"(?:[^"\\\n]|\\.)*"\s*:|\})|\[\s*(?:["{\[\d-]|true|false|null|\])')


def judge(text: str | None, language: str | None) -> tuple[str, str | None]:
    """(verdict, language found): 'valid'; 'suspect' where the text is valid but another language ranks clearly above and
    parses it too; 'wrong extension' with the language that does parse; 'corrupt'; 'unknown' where the language has no
    grammar here, its parser gave up or the content is null."""
    if text is None or language is None:
        return "unknown", None
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        return "valid", language
    if "\0" in text:
        return "corrupt", None
    own = grammar(language).valid(text)
    if own is None:
        return "unknown", None
    score = scores(text)
    for other in sorted(score, key=lambda k: (-score[k], k)):
        if own and score[other] <= 2 * score[language] + 2:
            return "valid", language
        if other != language and (language, other) not in _CONTAINS and grammar(other).valid(text):
            return ("suspect" if own else "wrong extension"), other
    return ("valid", language) if own else ("corrupt", None)


def _language(by_extension, declared):
    ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    named = F.element_at(alias, F.lower(F.trim(declared))) if declared is not None else F.lit(None).cast("string")
    return F.when(by_extension != "", F.element_at(ext, by_extension)).otherwise(named)


def with_language(repo_files: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, repo_path, file_path, content, language. Only files without an extension are joined with the
    declarations (one per id: the greatest non-null), so that no other content is shuffled."""
    base = spread(repo_files.select("file_id", "repo_path", "file_path", "content", extension(F.coalesce("file_path", F.lit(""))).alias("ext")))
    named = base.where(F.col("ext") != "").withColumn("language", _language(F.col("ext"), None)).drop("ext")
    declared = files.where(F.col("id").isNotNull() & F.col("language").isNotNull()).groupBy("id").agg(F.max("language").alias("declared"))
    bare = base.where(F.col("ext") == "").join(declared, F.col("file_id") == F.col("id"), "left")
    bare = bare.withColumn("language", _language(F.col("ext"), F.col("declared"))).select(*named.columns)
    return named.unionByName(bare)


def check_files(repo_files: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, repo_path, file_path, language, verdict, found of every row; rows written twice stay twice."""
    src = with_language(repo_files, files)

    def run(batches):
        for b in batches:
            got = [judge(None if pd.isna(t) else t, None if pd.isna(lang) else lang) for t, lang in zip(b["content"], b["language"])]
            yield pd.DataFrame(
                {"file_id": b["file_id"], "repo_path": b["repo_path"], "file_path": b["file_path"], "language": b["language"], "verdict": [v for v, _ in got], "found": [f for _, f in got]}
            )

    return src.mapInPandas(run, "file_id bigint, repo_path string, file_path string, language string, verdict string, found string")


def invalid_files(repo_files: DataFrame, files: DataFrame) -> DataFrame:
    """The files that do not parse, each once: file_id, language, verdict, found."""
    bad = check_files(repo_files, files).where(F.col("verdict").isin("corrupt", "wrong extension"))
    return bad.groupBy("file_id").agg(F.min(F.struct("language", "verdict", "found")).alias("r")).select("file_id", "r.*")


def invalid_rates(repo_files: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository and language: files with a verdict, corrupt ones, wrong extensions, rate of both, suspect ones."""
    one = check_files(repo_files, files).where(F.col("verdict") != "unknown").groupBy("repo_path", "language", "file_id").agg(F.min("verdict").alias("v"))
    n = F.count("*")
    return one.groupBy("repo_path", "language").agg(
        n.alias("n_files"), F.count_if(F.col("v") == "corrupt").alias("n_corrupt"), F.count_if(F.col("v") == "wrong extension").alias("n_wrong_extension"), (F.count_if(F.col("v").isin("corrupt", "wrong extension")) / n).alias("rate"),
        F.count_if(F.col("v") == "suspect").alias("n_suspect"),
    )
