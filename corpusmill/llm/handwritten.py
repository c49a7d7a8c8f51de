"""Telling hand-written source from generated, minified, vendored files and data saved as code.

Generation notices and third-party banners are matched by one multi-pattern automaton in all comment lines before the
first and after the last line of code, where such notices stand; one in a string or between lines of code is none. Path rules know the folders
of vendored code, lock files and minified suffixes. What carries no notice shows in its shape: lines too long and dense
to be typed, literals that make up nearly the whole file, or member names numbered throughout. A copy of a vendored
file that was moved elsewhere without its banner is found by the fingerprint of its body.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import checkpoint, spread

# (phrase, kind, weight); phrases are matched in lower case with runs of white space as one blank
NOTICES = [
    # generated, said by tools
    ("<auto-generated", "g", 2), ("@generated", "g", 2), ("code generated by", "g", 2), ("code generated from", "g", 2), ("autogenerated", "g", 2), ("auto-generated", "g", 2),
    ("auto generated", "g", 2), ("automatically generated", "g", 2), ("generated automatically", "g", 2), ("created automatically by", "g", 2), ("machine-made", "g", 2), ("machine generated", "g", 2),
    ("machine-generated", "g", 2), ("file is generated", "g", 2), ("file was generated", "g", 2), ("generated by", "g", 1), ("generated from", "g", 1), ("produced by", "g", 1), ("built from", "g", 1), ("derived from", "g", 0),
    ("source of truth:", "g", 1), ("to refresh", "g", 1), ("to regenerate", "g", 1), ("manual changes will be", "g", 1), ("changes will be lost", "g", 1), ("will be overwritten", "g", 1), ("any changes made", "g", 1),
    ("do not edit.", "g", 1), ("do not edit by hand", "g", 1), ("do not edit manually", "g", 1), ("do not edit this file", "g", 1), ("do not modify", "g", 1), ("do not hand-edit", "g", 1),
    ("automatisch erzeugt", "g", 2), ("automatisch generiert", "g", 2), ("generiert von", "g", 1), ("erzeugt von", "g", 1), ("erzeugt aus", "g", 1), ("nicht von hand", "g", 1), ("nicht bearbeiten", "g", 1), ("nicht ändern", "g", 1),
    ("fichier produit par", "g", 2), ("fichier généré", "g", 2), ("généré par", "g", 1), ("généré automatiquement", "g", 2), ("produit automatiquement", "g", 2), ("ne pas modifier", "g", 1), ("ne pas éditer", "g", 1),
    ("generado automáticamente", "g", 2), ("archivo generado", "g", 2), ("fichero generado", "g", 2), ("generado por", "g", 1), ("generado a partir", "g", 1), ("no editar", "g", 1), ("no modificar", "g", 1),
    ("gerado automaticamente", "g", 2), ("não edite", "g", 1), ("generato automaticamente", "g", 2), ("non modificare", "g", 1), ("自動生成", "g", 2), ("自动生成", "g", 2), ("编辑", "g", 1), ("編集しないで", "g", 1), ("автоматически", "g", 2), ("не редактировать", "g", 1),
    # what hand-written files say that sounds alike
    ("hand-maintained", "g", -4), ("maintained by hand", "g", -4), ("written by hand", "g", -4), ("hand-written", "g", -4), ("this script generates", "g", -4), ("not generated", "g", -4),
    # third-party banners
    ("source archive", "v", 1), ("imported from the", "v", 1), ("see upstream", "v", 1), ("this is a copy of", "v", 2), ("vendored", "v", 2), ("copied from", "v", 1), ("local patches", "v", 1), ("upstream version", "v", 1),
    ("contributors, released", "v", 2), ("contributors. released", "v", 2), ("released under the", "v", 1), ("licensed under the", "v", 1), ("distributed under the", "v", 1), ("; part of", "v", 1), ("this file is part of", "v", 1),
    ("| bsd-", "v", 2), ("| mit", "v", 2), ("| apache-", "v", 2), ("| isc", "v", 2), ("| mpl-", "v", 2), ("| gpl-", "v", 2), ("spdx-license-identifier", "v", 1), ("(c) ", "v", 0), ("copyright ", "v", 0),
    # the own people's banners
    ("internal use", "v", -4), ("the project authors", "v", -4), ("all rights reserved", "v", -1), ("owner: team", "v", -4),
]

VENDORED_DIRS = (
    "vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "pods", "carthage",
    "site-packages", "dist-packages", ".yarn", ".bundle", ".venv", "venv", "godeps", "elm-stuff", "_vendor",
)
#: Folders that hold third-party copies in some repositories and own code in others: the path alone does not tell.
PERHAPS_VENDORED_DIRS = ("external", "externals", "extern", "deps", "contrib")
#: Bodies with fewer characters than this, white space aside, are too common to tell a copy.
SHORTEST_BODY = 80
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "gemfile.lock", "poetry.lock", "pipfile.lock", "cargo.lock", "go.sum", "podfile.lock", "packages.lock.json", "flake.lock", "mix.lock",
)
_MIN_NAME = re.compile(r"[.-]min\.(js|css|mjs|cjs)$|\.(bundle|chunk|prod)\.(js|css|mjs)$|(^|/)bundle\.[0-9a-f]{6,}\.js$|\.[0-9a-f]{8,}\.(js|css)$")
_BANNER = re.compile(r"^\W*[!*]\s*(?:@license\s+)?[\w@./-]+\s+v?\d+(?:\.\d+)+\b")
_VERSIONED_DIR = re.compile(r"(^|/)[a-z][\w-]*-\d+\.\d+(\.\d+)?/")
_VERSION = re.compile(r"[-@]v?\d+(\.\d+)+.*$")
_NAME_VERSION = re.compile(r"\b[a-z][\w-]*[ -]v?\d+\.\d+(?:\.\d+)?\b")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|<!--|--\s|;|\"\"\"|''')")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b|[A-Za-z_$@][\w$]*")
_NUMBERED = re.compile(r".*?[A-Za-z_]\d{1,4}(?:_|[A-Z][A-Za-z]*)?$")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")
_JOINED = re.compile(r"[;}](?=[\w$!(\[])")
_LINE_COMMENT = re.compile(r"#|//|--\s|;")
_PACKAGE = re.compile(r"package\s+[\w.]+\s*;?$")
_IMPORT = re.compile(r"import\b")
_MULTILINE = ('"""', "'''", "`")  # of strings that span lines
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})")

#: Lines longer than this count as dense if they are code with little white space.
LONG_LINE = 220

_automaton = None


def automaton():
    """The phrases as one Aho-Corasick automaton, made once per worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase, kind, weight in NOTICES:
            a.add_word(phrase, (kind, weight, phrase))
        a.make_automaton()
        _automaton = a
    return _automaton


def _joined(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def head_comments(text: str) -> str:
    """All comment lines before the first line of code, in lower case; markers of a merge conflict are passed over.

    So is a package clause: comments below it count if a blank line or an import follows, else they describe a member.
    """
    out, below, block, package = [], [], False, False
    for line in text.lstrip("\ufeff").splitlines():
        s = line.strip()
        if not s or _CONFLICT.match(s):
            if not s and not block:
                out, below = out + below, []
            continue
        to = below if package else out
        if not block and (s.startswith("/*") or s.startswith("<!--")):
            end = "*/" if s.startswith("/*") else "-->"
            block = end not in s[2:]
            to.append(s if block else s[: s.index(end, 2)])
            if not block and len(s) > s.index(end, 2) + len(end):
                break
        elif block or _COMMENT.match(line):
            to.append(s)
            if "*/" in s or "-->" in s:
                block = False
        elif not package and _PACKAGE.match(s):
            package = True
        else:
            return _joined(out + below if _IMPORT.match(s) else out)
    return _joined(out + below)


def tail_comments(text: str) -> str:
    """All comment lines after the last line of code, in lower case.

    Comments set deeper than the first line of code belong to the code. Comment-like lines in which a string that began
    in the code ends are part of that string.
    """
    lines = text.lstrip("\ufeff").splitlines()
    margin = next((len(x) - len(x.lstrip()) for x in lines if x.strip() and not _COMMENT.match(x) and not _CONFLICT.match(x)), None)
    if margin is None:
        return ""  # all of it is head
    first = i = len(lines)
    while i:
        i -= 1
        s = lines[i].strip()
        if not s or _CONFLICT.match(s):
            continue
        begin = i
        end = next((e for e in ("*/", "-->") if s.endswith(e)), None)
        if end and not _LINE_COMMENT.match(s):
            start = "/*" if end == "*/" else "<!--"
            while begin and not lines[begin].lstrip().startswith(start) and start not in lines[begin] and (begin == i or end not in lines[begin]):
                begin -= 1
            if not lines[begin].lstrip().startswith(start) or begin < i and end in lines[begin]:
                break
        elif not _LINE_COMMENT.match(s):
            break
        if len(lines[begin]) - len(lines[begin].lstrip()) > margin:
            break
        first = i = begin
    if first == len(lines):
        return ""
    tail = lines[first:]
    body = None
    for quote in _MULTILINE:
        if sum(x.count(quote) for x in tail) % 2:
            body = "\n".join(lines[:first]) if body is None else body
            if body.count(quote) % 2:
                tail = tail[max(k for k, x in enumerate(tail) if quote in x) + 1 :]
    return _joined([x for x in tail if not _CONFLICT.match(x.strip())])


def notice_scores(head: str) -> tuple[int, int]:
    """(generated, vendored): sums of the weights of the different phrases found."""
    found = {p: (k, w) for _, (k, w, p) in automaton().iter(head)} if head else {}
    g = sum(w for k, w in found.values() if k == "g")
    v = sum(w for k, w in found.values() if k == "v")
    if v > 0 and not _NAME_VERSION.search(head):
        v = min(v, 1)  # a licence alone, without a named release, is the file's own
    if v >= 0 and _BANNER.match(head):
        v += 2
    return g, v


def path_kind(path: str) -> str | None:
    """'vendored', 'lockfile', 'minified' by the path alone, else None."""
    low = path.lower()
    segments = low.split("/")
    if segments[-1] in LOCKFILES:
        return "lockfile"
    if any(s in VENDORED_DIRS for s in segments[:-1]) or _VERSIONED_DIR.search(low):
        return "vendored"
    if _MIN_NAME.search(low):
        return "minified"
    return None


def shape(text: str) -> str | None:
    """'minified', 'data' or 'generated' by what the text looks like, else None."""
    n = len(text)
    if n < 40:
        return None
    lines = [s for s in text.splitlines() if s.strip()]
    body = [s for s in lines if not _COMMENT.match(s) or len(s) > LONG_LINE]
    solid = sum(map(len, body))
    if not solid:
        return None
    tokens = _TOKEN.findall("\n".join(body))
    literal = [t for t in tokens if t[0] in "\"'-0123456789"]
    size = sum(len(t) for t in literal if " " not in t)  # prose and queries are no data
    names = [t for t in tokens if t[0] not in "\"'-0123456789"]
    packed = solid - sum(s.count(" ") + s.count("\t") for s in body)
    if len(literal) >= 1 and size >= 400 and size >= 0.62 * packed and len(names) <= max(12, 0.15 * len(literal)) + 4:
        return "data"
    dense = sum(len(s) for s in body if len(s) > LONG_LINE and _dense(s))
    joined = len(_JOINED.findall(_STRING.sub("''", "\n".join(body))))
    if dense >= 0.5 * solid or solid >= 100 and joined >= max(3, 1.5 * len(body)):
        return "minified"
    if len(names) >= 12:
        numbered = [t for t in names if _NUMBERED.match(t)]
        if len(numbered) >= 0.22 * len(names) and len(set(numbered)) >= 3:
            return "generated"
    rows = sum(1 for s in lines if s.lstrip()[:1] in "[{(" and s.count(",") >= 6)
    if rows >= 8 and rows >= 0.35 * len(lines):
        return "generated"  # parse tables
    return None


def _dense(s: str) -> bool:
    t = s.lstrip()
    if _COMMENT.match(s) and not t.startswith("/*!"):
        return False
    code = _STRING.sub("''", t)
    return len(code) > LONG_LINE and code.count(" ") + code.count("\t") < 0.22 * len(code)


def classify(path: str, text: str | None) -> tuple[str | None, str]:
    """(kind or None, reason) of one file; null and blank texts are no case."""
    if text is None or not text.strip():
        return None, ""
    by_path = path_kind(path or "")
    if by_path in ("lockfile", "vendored"):
        return by_path, "path"
    head = head_comments(text)
    g, v = notice_scores(head)
    if v >= 2:
        return "vendored", "banner"
    if g >= 2:
        return "generated", "notice"
    below, v = notice_scores(tail_comments(text))
    if v >= 2:
        return "vendored", "banner"
    if below + min(g, 0) >= 2:  # a head that says the file is hand-written counts against it
        return "generated", "notice"
    if by_path == "minified":
        return "minified", "path"
    s = shape(text)
    return (s, "shape") if s else (None, "")


def library(path: str | None) -> str | None:
    """Name of the folder under one that holds, or may hold, third-party copies, without a version; None elsewhere."""
    segments = (path or "").lower().split("/")
    for k in range(len(segments) - 3, -1, -1):  # the file itself is no library
        if segments[k] in VENDORED_DIRS or segments[k] in PERHAPS_VENDORED_DIRS:
            return _VERSION.sub("", segments[k + 1])
    return None


def body_fingerprint(text: str | None) -> str | None:
    """Hash of the code below the head comments, without white space; null for bodies too short to tell copies."""
    if text is None:
        return None
    import xxhash

    lines = text.lstrip("\ufeff").splitlines()
    i = 0
    while i < len(lines) and (not lines[i].strip() or _CONFLICT.match(lines[i]) or _COMMENT.match(lines[i]) and not lines[i].lstrip().startswith(('"""', "'''"))):
        i += 1
    body = "".join("".join(lines[i:]).split())
    return xxhash.xxh3_128_hexdigest(body.encode()) if len(body) >= SHORTEST_BODY else None


def classify_files(files: DataFrame) -> DataFrame:
    """file_id, repo_path, file_path, kind, reason, body, library of every row; row by row, without a shuffle.

    kind is null for hand-written files and for null or empty contents. Rows written twice stay twice.
    """
    kept = spread(files.select("file_id", "repo_path", "file_path", "content"))

    def run(batches):
        for b in batches:
            got = [classify(p, c) for p, c in zip(b["file_path"], b["content"])]
            yield pd.DataFrame(
                {"file_id": b["file_id"], "repo_path": b["repo_path"], "file_path": b["file_path"], "kind": [k for k, _ in got], "reason": [r for _, r in got], "body": [body_fingerprint(c) for c in b["content"]], "library": [None if c is None or not c.strip() else library(p) for p, c in zip(b["file_path"], b["content"])]}
            )

    return kept.mapInPandas(run, "file_id bigint, repo_path string, file_path string, kind string, reason string, body string, library string")


def not_hand_written(files: DataFrame) -> DataFrame:
    """file_id, repo_path, file_path, kind, reason of the files that are not hand-written, each file once.

    Besides those that `classify` finds, a file whose body is the body of a vendored one is a copy of it, and so is a file
    in a folder such as `external/name/` if `name` is a library that surely vendored files belong to. Bodies and names of
    vendored files are joined; they are distinct, so one with very many copies meets one row, and AQE splits the side of
    the copies. Rows without a key get one of their own, so that they don't meet in one partition. The contents are read
    once; the small verdicts are checkpointed and used again.
    """
    own = F.concat(F.lit("~"), F.coalesce(F.col("file_id").cast("string"), F.lit("")))
    got = checkpoint(classify_files(files).withColumns({"body": F.coalesce("body", own), "library": F.coalesce("library", own)}))
    sure = got.where(F.col("kind") == "vendored")
    bodies = sure.where(~F.col("body").startswith("~")).select("body").distinct().withColumn("copy", F.lit("copy of a vendored file"))
    names = sure.where(~F.col("library").startswith("~")).select("library").distinct().withColumn("named", F.lit("folder of a vendored library"))
    decided = got.where(F.col("kind").isNotNull()).select("file_id", "repo_path", "file_path", "kind", "reason")
    rest = got.where(F.col("kind").isNull()).join(bodies, "body", "left")
    linked = rest.join(names, "library", "left").withColumn("reason", F.coalesce("copy", "named")).where(F.col("reason").isNotNull())
    both = decided.unionByName(linked.select("file_id", "repo_path", "file_path", F.lit("vendored").alias("kind"), "reason"))
    return both.groupBy("file_id").agg(F.min(F.struct("repo_path", "file_path", "kind", "reason")).alias("r")).select("file_id", "r.*")
