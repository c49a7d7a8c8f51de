"""Operators on the lines of a text. They work on one row's arrays, so that texts are not shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T
from corpusmill.functions.lang import any_dir_in

# fixed values: the patterns of code and text summaries, the first that matches gives the kind
CODE_PATTERNS = [
    (r"^\s*class\s+\w+", "class"),
    (r"^\s*def\s+\w+", "function"),
    (r"^\s*function\s+\w+", "function"),
    (r"^\s*(import|from)\s+", "import"),
    (r"^\s*@\w+", "decorator"),
    (r"^\s*(public|private|protected)\s+class\s+\w+", "class"),
    (r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s*\(", "function"),
]
TEXT_MARK = r"^#{1,6}\s+|^\s*[-*+]\s+|^\s*\d+\.\s+"


def numbered_lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, i (from 1), line: one row per line (split at LF), without a shuffle."""
    return df.select(*keep, F.posexplode(T.lines(F.col(text))).alias("_p", "line")).select(*keep, (F.col("_p") + 1).alias("i"), "line")


def fixed_windows(df: DataFrame, keep: list[str], text: str, size: int = 30, overlap: int = 15) -> DataFrame:
    """keep, start (0-based), end (exclusive), piece: windows every size - overlap lines. Tail windows that the one
    before covers stay, as chunk indexes have them."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    n = df.select(*keep, T.lines(F.col(text)).alias("_a"))
    n = n.select(*keep, "_a", F.explode(F.sequence(F.lit(0), F.size("_a") - 1, F.lit(size - overlap))).alias("start"))
    end = F.least(F.col("start") + size, F.size("_a"))
    return n.select(*keep, "start", end.alias("end"), F.array_join(F.slice("_a", F.col("start") + 1, F.lit(size)), "\n").alias("piece"))


def match_lines(text: Column, hit) -> Column:
    """1-based numbers of the lines for which `hit(line)` holds."""
    flags = F.transform(T.lines(text), lambda l, i: F.when(hit(l), i + 1))
    return F.filter(flags, lambda x: x.isNotNull())


def islands(df: DataFrame, keep: list[str], text: str, hit, context: int = 2, most: int | None = None) -> DataFrame:
    """keep, first, last, body, matches: runs of matching lines with their context. Runs are cut where a line number
    jumps by two or more; lines are right-trimmed and long ones shortened. `most` caps the islands of the whole result
    in the order of `keep`, which is the search tool's page size."""
    m = df.select(*keep, F.col(text).alias("_t"), match_lines(F.col(text), hit).alias("_m")).where(F.size("_m") > 0)
    m = m.select(*keep, T.lines(F.col("_t")).alias("_a"), "_m")
    fold = f"""aggregate(_m, cast(array() as array<struct<s:int,e:int,ms:array<int>>>), (acc, m) ->
      CASE WHEN size(acc) > 0 AND greatest(m - {context}, 1) - element_at(acc, -1).e < 2
      THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', least(m + {context}, size(_a)), 'ms', array_append(element_at(acc, -1).ms, m))))
      ELSE array_append(acc, named_struct('s', greatest(m - {context}, 1), 'e', least(m + {context}, size(_a)), 'ms', array(m))) END)"""
    x = m.select(*keep, "_a", F.explode(F.expr(fold)).alias("x"))
    cut = F.transform(F.slice("_a", F.col("x.s"), F.col("x.e") - F.col("x.s") + 1), lambda l: T.truncated_line(F.regexp_replace(l, r"[ \t\r\f]+$", "")))
    out = x.select(*keep, F.col("x.s").alias("first"), F.col("x.e").alias("last"), F.array_join(cut, "\n").alias("body"), F.col("x.ms").alias("matches"))
    return out if most is None else out.orderBy(*keep, "first").limit(most)


def code_kind(line: Column) -> Column:
    out = None
    for pattern, kind in CODE_PATTERNS:
        out = F.when(line.rlike(pattern), kind) if out is None else out.when(line.rlike(pattern), kind)
    return out


def summarize_code(df: DataFrame, keep: list[str], text: str, most: int = 200) -> DataFrame:
    """keep, i, kind, shown: lines that declare something, at most `most` per text; blank and # lines are passed over."""
    arr = F.transform(T.lines(F.col(text)), lambda l, i: F.struct((i + 1).alias("i"), code_kind(l).alias("kind"), l.alias("l")))
    hit = F.filter(arr, lambda x: x["kind"].isNotNull() & (F.trim(x["l"]) != "") & ~F.ltrim(x["l"]).startswith("#"))
    rows = df.select(*keep, F.explode(F.slice(hit, 1, most)).alias("x"))
    return rows.select(*keep, F.col("x.i").alias("i"), F.col("x.kind").alias("kind"), F.concat(F.col("x.i").cast("string"), F.lit(": "), F.col("x.l")).alias("shown"))


def summarize_text(df: DataFrame, keep: list[str], text: str, most: int = 200) -> DataFrame:
    """keep, i, shown: all headers and list items, then evenly spaced other lines until `most`, by line number."""
    a = df.select(*keep, T.lines(F.col(text)).alias("_a"))
    mark = lambda l: (F.trim(l) != "") & l.rlike(TEXT_MARK)
    marks = F.filter(F.transform("_a", lambda l, i: F.when(mark(l), i + 1)), lambda x: x.isNotNull())
    a = a.select(*keep, "_a", marks.alias("_m"), F.size("_a").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest(F.lit(most) - F.size("_m"), F.lit(1))).cast("int"))
    fill = F.filter(
        F.transform(F.sequence(F.lit(0), F.col("_n") - 1, F.col("_step")), lambda i: i + 1), lambda i: (F.trim(F.get("_a", i - 1)) != "") & ~F.array_contains("_m", i)
    )
    a = a.withColumn("_step", step).select(*keep, "_a", "_m", F.when(F.size("_m") < most, F.slice(fill, F.lit(1), F.greatest(F.lit(most) - F.size("_m"), F.lit(0)))).otherwise(F.array().cast("array<int>")).alias("_f"))
    rows = a.select(*keep, "_a", F.explode(F.array_sort(F.concat("_m", "_f"))).alias("i"))
    return rows.select(*keep, "i", F.concat(F.col("i").cast("string"), F.lit(": "), F.get("_a", F.col("i") - 1)).alias("shown"))


def sample_lines(df: DataFrame, keep: list[str], text: str, most: int = 200) -> DataFrame:
    """keep, i: all lines of short texts; of longer ones every (n // most)-th, at most `most`."""
    a = df.select(*keep, F.size(T.lines(F.col(text))).alias("_n"))
    step = F.when(F.col("_n") > most, F.floor(F.col("_n") / most).cast("int")).otherwise(F.lit(1))
    return a.select(*keep, F.explode(F.slice(F.sequence(F.lit(1), F.col("_n"), step), 1, most)).alias("i"))


def skipped(df: DataFrame, keep: list[str], text: str, most: int = 200) -> DataFrame:
    """keep, first, last: the runs of lines that `sample_lines` leaves out."""
    a = df.select(*keep, F.size(T.lines(F.col(text))).alias("_n"))
    step = F.when(F.col("_n") > most, F.floor(F.col("_n") / most).cast("int")).otherwise(F.lit(1))
    a = a.select(*keep, "_n", F.slice(F.sequence(F.lit(1), F.col("_n"), step), 1, most).alias("_k"))
    ends = F.transform("_k", lambda k, j: F.struct((k + 1).alias("first"), F.coalesce(F.get("_k", j + 1) - 1, F.col("_n")).alias("last")))
    return a.select(*keep, F.explode(F.filter(ends, lambda x: x["first"] <= x["last"])).alias("x")).select(*keep, "x.*")


def import_blocks(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, first, last, n: consecutive import lines with only blank or comment lines between them."""
    a = df.select(*keep, T.lines(F.col(text)).alias("_a"))
    hit = lambda l: l.rlike(r"^\s*(?:import|from|require|package)\b")
    code = F.transform("_a", lambda l, i: F.struct((i + 1).alias("i"), F.when(hit(l), 1).when(T.is_comment_or_blank(l), 0).otherwise(2).alias("k")))
    kept = a.select(*keep, F.filter(code, lambda x: x["k"] > 0).alias("_c"))
    fold = """aggregate(_c, cast(array() as array<struct<s:int,e:int,n:int,open:boolean>>), (acc, x) ->
      CASE WHEN x.k = 2 THEN CASE WHEN size(acc) > 0 AND element_at(acc, -1).open THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', element_at(acc, -1).e, 'n', element_at(acc, -1).n, 'open', false))) ELSE acc END
      WHEN size(acc) > 0 AND element_at(acc, -1).open THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', x.i, 'n', element_at(acc, -1).n + 1, 'open', true)))
      ELSE array_append(acc, named_struct('s', x.i, 'e', x.i, 'n', 1, 'open', true)) END)"""
    return kept.select(*keep, F.explode(F.expr(fold)).alias("x")).select(*keep, F.col("x.s").alias("first"), F.col("x.e").alias("last"), F.col("x.n").alias("n"))


def declarations(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, i, kind, name: classes and functions by their first line, whatever the language."""
    pat = r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|async\s+)*(class|interface|def|func|fun|function)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"
    arr = F.transform(T.lines(F.col(text)), lambda l, i: F.struct((i + 1).alias("i"), F.regexp_extract(l, pat, 1).alias("w"), F.regexp_extract(l, pat, 2).alias("name")))
    rows = df.select(*keep, F.explode(F.filter(arr, lambda x: x["w"] != "")).alias("x"))
    return rows.select(*keep, F.col("x.i").alias("i"), F.when(F.col("x.w").isin("class", "interface"), "class").otherwise("function").alias("kind"), F.col("x.name").alias("name"))


class EmptyResult(LookupError):
    """A search without a result."""


def grep(
    files: DataFrame, keep: list[str], path: str, text: str, term: str, regex: bool = False, ignore_case: bool = False, directory: str = "", exclude_dirs: tuple = (), exclude_suffixes: tuple = (), most_bytes: int = 200 * 1024, limit: int = 50
) -> DataFrame:
    """keep, path, first, last, body, matches: the islands of matching lines of the files under a directory, outside the
    excluded folders and suffixes and not larger than `most_bytes`; the first `limit` by path and line, a page's size."""
    t = F.lower(F.lit(term)) if ignore_case and not regex else F.lit(term)
    fold = F.lower if ignore_case and not regex else (lambda c: c)
    hit = (lambda l: l.rlike(("(?i)" if ignore_case else "") + term)) if regex else (lambda l: F.contains(fold(l), t))
    x = files.where(F.octet_length(text) <= most_bytes)
    if directory:
        x = x.where(F.col(path).startswith(directory.rstrip("/") + "/"))
    if exclude_dirs:
        x = x.where(~any_dir_in(F.col(path), list(exclude_dirs)))
    for suffix in exclude_suffixes:
        x = x.where(~F.col(path).endswith(suffix))
    return islands(x, [*keep, path], text, hit).orderBy(path, *keep, "first").limit(limit)


def or_error(found: DataFrame, message: str) -> DataFrame:
    """The result itself, or an error where it is empty; this runs the search."""
    if found.isEmpty():
        raise EmptyResult(message)
    return found
