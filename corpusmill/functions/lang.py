"""Languages, file kinds, path predicates, denotations and the lines that version control prints."""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions.paths import base_name, extension

# fixed values: search types and the properties they look in
PROPERTIES = {"class": ["classes"], "function": ["functions"], "file": ["searchable_file_path", "searchable_file_name"]}

# fixed values: language in the symbol index by whole name, compound suffix or suffix
SPECIAL_FILES = {
    "Dockerfile": "docker", "Makefile": "makefile", ".bashrc": "bash", ".zshrc": "bash", ".gitignore": "gitignore", "CMakeLists.txt": "cmake", "requirements.txt": "python-requirements", "package.json": "npm-config", "Pipfile": "python-pipenv",
}
SUFFIXES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".h": "cpp", ".hpp": "cpp", ".go": "go", ".rb": "ruby", ".php": "php",
    ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".m": "objective-c", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".sql": "sql",
    ".html": "html", ".css": "css", ".scss": "scss", ".md": "markdown", ".rst": "restructuredtext", ".spec.ts": "typescript", ".test.js": "javascript", ".tar.gz": "archive", ".tgz": "archive",
}
# fixed values: language whose parser reads a file, by lower-cased name or suffix
PARSED_NAMES = {"dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "cmakelists.txt": "cmake"}
PARSED_SUFFIXES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "hpp": "cpp", "go": "go", "rs": "rust", "rb": "ruby", "html": "html", "kt": "kotlin", "json": "json", "swift": "swift",
}
# fixed values: kinds of files by suffix
CODE_SUFFIXES = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".h", ".hpp", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".css", ".html", ".htm", ".sql", ".lua", ".dart", ".r", ".elm", ".zig", ".sh", ".bash",
]
TEXT_SUFFIXES = [".md", ".txt", ".rst", ".tex", ".org", ".adoc", ".textile"]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".xml", ".properties", ".conf", ".config"]
BINARY_SUFFIXES = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".exe", ".dll", ".so", ".dylib", ".bin", ".pyc", ".pyo",
    ".class", ".jar", ".war", ".mp3", ".mp4", ".avi", ".mov", ".wmv",
]
IGNORED_PARTS = ["__pycache__", ".git", "node_modules", ".venv", "venv"]
CODE_LOOK, CONFIG_LOOK = r"\b(class|def|function|import)\b", r"(?m)^[\w-]+\s*[:=]"
MAX_SUMMARISED_BYTES, SUMMARY_FROM_LINES = 50 * 1024 * 1024, 1000


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def all_suffixes(path: Column) -> Column:
    """All suffixes of the base name together, lower-cased; leading dots begin no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.]+((?:\.[^.]+)+)$", 1))


def guess_language(path: Column) -> Column:
    """Of the symbol index: by the whole name as it is written, else by all suffixes together, else by the last one, else
    'unknown'."""
    return F.coalesce(_lookup(SPECIAL_FILES, base_name(path)), _lookup(SUFFIXES, all_suffixes(path)), _lookup(SUFFIXES, extension(path)), F.lit("unknown"))


def parser_language(path: Column) -> Column:
    """Language whose parser reads the file, by its lower-cased name, else by what follows the last dot; else null."""
    low = F.lower(path)
    return F.coalesce(_lookup(PARSED_NAMES, base_name(low)), _lookup(PARSED_SUFFIXES, F.when(low.contains("."), F.substring_index(low, ".", -1))))


def file_type(path: Column, head: Column) -> Column:
    """'code', 'text', 'config' or 'unknown' by the suffix or name, else by what the first characters look like."""
    ext, name = extension(path), F.lower(base_name(path))
    by_look = F.when(head.rlike(CODE_LOOK), "code").when(head.rlike(CONFIG_LOOK), "config").otherwise("unknown")
    return (
        F.when(ext.isin(CODE_SUFFIXES) | name.isin("dockerfile", "makefile"), "code").when(ext.isin(TEXT_SUFFIXES), "text")
        .when(ext.isin(CONFIG_SUFFIXES) | name.startswith(".env"), "config").when(head != "", by_look).otherwise("unknown")
    )


def ignored(path: Column) -> Column:
    """Files in an ignored folder, or with the suffix of a binary format."""
    return any_part_in(path, IGNORED_PARTS) | extension(path).isin(BINARY_SUFFIXES)


def summary_kind(path: Column, head: Column, size: Column) -> Column:
    """How a file is summarised: 'code', 'text', or 'sampling' for other kinds; 'not supported' for ignored files and 'too
    large' above the limit."""
    kind = file_type(path, head)
    return F.when(ignored(path), "not supported").when(size > MAX_SUMMARISED_BYTES, "too large").when(kind.isin("code", "text"), kind).otherwise("sampling")


def any_part_in(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def any_dir_in(path: Column, names: list[str]) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(n) for n in names]))


def chunkable(path: Column, size: Column, dirs: list[str], exts: list[str], most: int = 8 << 20) -> Column:
    """Suffix and folders not excluded, size within the limit. Only the last suffix counts, and only relative folders."""
    return ~extension(path).isin(*exts) & ~any_dir_in(path, dirs) & (size <= most)


def outside_globs(df: DataFrame, path: str, dirs: list[str], exts: list[str]) -> DataFrame:
    return df.where(~any_dir_in(F.col(path), dirs) & ~extension(F.col(path)).isin(*exts))


def pruned(path: Column, names: set[str], globs: list[str]) -> Column:
    """Paths with a folder in `names`, a hidden folder, or one that matches a glob."""
    pats = [fnmatch.translate(g).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "").replace(".*", "[^/]*") for g in globs] + [r"\.[^/]*"]
    hit = path.rlike("(?:^|/)(?:" + "|".join(pats) + ")/")
    return hit | any_dir_in(path, sorted(names)) if names else hit


def under(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def listing(df: DataFrame, root: str, path: str) -> DataFrame:
    """root, name, kind of what lies directly under each root."""
    parts = F.split(path, "/")
    return df.select(root, F.element_at(parts, 1).alias("name"), F.when(F.size(parts) > 1, "dir").otherwise("file").alias("kind")).distinct()


def parse_tree_listing(df: DataFrame, line: str) -> DataFrame:
    """Columns file_hash and file_path from lines `mode blob hash<TAB>path`; other kinds of entries are left out."""
    pat = r"(?s)^\d{6} blob (\S+)\t(.*)$"
    return df.where(F.col(line).rlike(pat)).withColumn("file_hash", F.regexp_extract(line, pat, 1)).withColumn("file_path", F.regexp_extract(line, pat, 2)).drop(line)


def parse_status(df: DataFrame, line: str) -> DataFrame:
    """Columns status and file_path from short status lines; of a rename the new path counts."""
    rest = F.substring(line, 4, 1 << 30)
    new = F.when(rest.contains(" -> "), F.element_at(F.split(rest, " -> "), 2)).otherwise(rest)
    return df.withColumn("status", F.trim(F.substring(line, 1, 2))).withColumn("file_path", new).drop(line)


def lossy_utf8(raw: Column) -> Column:
    """Text of bytes in which what is not UTF-8 is left out."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return decode(raw)


def denotation(path: str, start: str, end: str) -> Column:
    return F.concat(F.col(path), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def values_of(hierarchy: str, kind: str) -> Column:
    return F.array_distinct(F.transform(F.filter(hierarchy, lambda x: (x["type"] == kind) & x["value"].isNotNull()), lambda x: x["value"]))


def symbol_kind(category: Column, node_type: Column) -> Column:
    t = node_type
    return (
        F.when(category == "import", "import").when(t.contains("class") | t.contains("interface"), "class").when(t.contains("func") | t.contains("method"), "function")
    )


def capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows by the order and, if rows are left out, one more with their number in `rest`."""
    first = df.orderBy(*order).limit(most).withColumn("rest", F.lit(None).cast("bigint"))
    more = df.agg((F.count("*") - most).alias("rest")).where(F.col("rest") > 0)
    head, *others = order
    return first.unionByName(more.select(F.lit("...").alias(head), *[F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in df.columns if c != head], "rest"))


def remote_parts(url: Column) -> Column:
    """host, owner, repo of a remote address in either form (`git@host:owner/repo.git`, `https://host/owner/repo`)."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^(?:https?://|ssh://|git@)(?:[^@/]*@)?", ""), r"(?:\.git)?/*$", "")
    pat = r"^([^/:]+)[:/](.*?)/?([^/]+)$"
    return F.struct(F.regexp_extract(plain, pat, 1).alias("host"), F.regexp_extract(plain, pat, 2).alias("owner"), F.regexp_extract(plain, pat, 3).alias("repo"))


def json_arguments(text: Column) -> Column:
    """Tool arguments that are a JSON object stay as they are, anything else is wrapped as `{"value": ...}`."""
    return F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{"), text).otherwise(F.to_json(F.struct(text.alias("value"))))
