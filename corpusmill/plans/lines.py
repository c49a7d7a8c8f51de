"""Queries of rendering, line chunks, grep, summaries and spans."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusmill.functions import lang as L, text as T
from corpusmill.functions.paths import base_name
from corpusmill.operators import lines as N
from corpusmill.session import read

from .tables import SAMPLES, SYMBOLS, TEXTS, samples, symbols, texts

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


LN = f"{TEXTS}, ar AS (SELECT file_id, string_split(content, chr(10)) AS a FROM tx), ln AS (SELECT file_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM ar)"
_DEN = "path || ':' || s || '-' || coalesce(e, s)"


def _den():
    return F.concat("path", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.coalesce("e", "s").cast("string"))


@query(f"WITH {SAMPLES} SELECT id, {_DEN} AS denotation FROM ck")
def denotation(spark, d):
    return samples(spark, d).select("id", _den().alias("denotation"))


@query(f"WITH {SAMPLES} SELECT count(DISTINCT text) AS n_texts, count(DISTINCT text) AS n_hashes FROM ck")
def content_hash(spark, d):
    """XXH64 tells apart exactly what differs; the value itself SQL cannot give."""
    h = samples(spark, d).select("text", T.xxh64_hex(F.col("text")).alias("h"))
    return h.agg(F.countDistinct("text").alias("n_texts"), F.countDistinct("h").alias("n_hashes"))


@query("WITH k AS (SELECT DISTINCT file_path, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(file_path)) AS h FROM repo_files) SELECT file_path, lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST(((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4) AS INT) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12))) AS key FROM k")
def uuid5_key(spark, d):
    return read(spark, d, "repo_files").select("file_path", T.uuid5(F.col("file_path")).alias("key")).distinct()


@query(f"WITH {TEXTS} SELECT file_id, md5(array_to_string(list_transform(string_split(content, chr(10)), lambda l, i: (i + 6) || ': ' || l), chr(10))) AS digest FROM tx")
def render_numbered(spark, d):
    return texts(spark, d).select("file_id", F.md5(T.numbered(F.col("content"), F.lit(7))).alias("digest"))


_META = "'<meta_data>' || chr(10) || coalesce('path: ' || path || chr(10), '') || coalesce('class: ' || cls || chr(10), '') || coalesce(repeat(chr(9), CAST(cls IS NOT NULL AS INT)) || 'function: ' || fn || chr(10), '') || '</meta_data>'"


def _meta():
    nl = F.lit("\n")
    tab = F.when(F.col("cls").isNotNull(), "\t").otherwise("")
    return F.concat(
        F.lit("<meta_data>\n"), F.coalesce(F.concat(F.lit("path: "), "path", nl), F.lit("")), F.coalesce(F.concat(F.lit("class: "), "cls", nl), F.lit("")), F.coalesce(F.concat(tab, F.lit("function: "), "fn", nl), F.lit("")), F.lit("</meta_data>")
    )


@query(f"WITH {SAMPLES} SELECT id, {_META} AS notes FROM ck")
def render_metadata_notes(spark, d):
    return samples(spark, d).select("id", _meta().alias("notes"))


@query(f"WITH {SAMPLES} SELECT id, md5({_META} || chr(10) || '<code>' || chr(10) || text || chr(10) || '</code>') AS digest FROM ck")
def render_with_meta(spark, d):
    return samples(spark, d).select("id", F.md5(F.concat(_meta(), F.lit("\n<code>\n"), "text", F.lit("\n</code>"))).alias("digest"))


@query(f"WITH {SAMPLES} SELECT path, md5(string_agg('<chunk source=\"' || {_DEN} || '\">' || text || '</chunk>', chr(10) ORDER BY s, id)) AS digest FROM ck WHERE path IS NOT NULL AND s IS NOT NULL GROUP BY 1")
def render_snippet_array(spark, d):
    x = samples(spark, d).where("path is not null and s is not null")
    one = F.struct("s", "id", F.concat(F.lit('<chunk source="'), _den(), F.lit('">'), "text", F.lit("</chunk>")).alias("x"))
    return x.groupBy("path").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]), "\n")).alias("digest"))


@query(f"WITH {SAMPLES} SELECT {_DEN} AS title, md5({_META} || text) AS digest FROM ck")
def chunks_to_docs(spark, d):
    return samples(spark, d).select(_den().alias("title"), F.md5(F.concat(_meta(), "text")).alias("digest"))


@query("SELECT DISTINCT file_path, regexp_extract(file_path, '[^/]*$') AS name FROM repo_files")
def searchable_file_name(spark, d):
    return read(spark, d, "repo_files").select("file_path", base_name(F.col("file_path")).alias("name")).distinct()


@query(f"WITH {SAMPLES} SELECT path, md5('find the bug' || chr(10) || string_agg(text, chr(10) ORDER BY s, id)) AS digest FROM ck WHERE path IS NOT NULL AND s IS NOT NULL GROUP BY 1")
def build_focus_query(spark, d):
    """A query with the chunks of a focus file after it, in their order; one file's chunks are what a request holds."""
    g = samples(spark, d).where("path is not null and s is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("s", "id", "text"))).alias("a"))
    return g.select("path", F.md5(F.concat(F.lit("find the bug\n"), F.array_join(F.transform("a", lambda x: x["text"]), "\n"))).alias("digest"))


@query(f"WITH {SAMPLES} SELECT id, path, s FROM ck")
def jsonify_chunks(spark, d):
    """Rows as JSON text and back."""
    j = samples(spark, d).select(F.to_json(F.struct("id", "path", "s")).alias("j"))
    return j.select(F.from_json("j", "id string, path string, s int").alias("x")).select("x.*")


@query(f"WITH {LN} SELECT file_id, i, md5(l[:97] || ' … ' || l[-97:] || ' (truncated, ' || length(l) || ' chars)') AS shown FROM ln WHERE length(l) > 200")
def truncate_long_line(spark, d):
    x = N.numbered_lines(texts(spark, d), ["file_id"], "content").where(F.length("line") > 200)
    return x.select("file_id", "i", F.md5(T.truncated_line(F.col("line"))).alias("shown"))


@query(f"WITH {SAMPLES} SELECT id, path, s, coalesce(e, s) AS e FROM ck WHERE path IS NOT NULL AND s IS NOT NULL")
def parse_focus_snippet(spark, d):
    x = samples(spark, d).where("path is not null and s is not null").select("id", _den().alias("x"))
    pat = r"(?s)^(.*):(-?\d+)-(-?\d+)$"
    g = lambda k: F.regexp_extract("x", pat, k)
    return x.select("id", g(1).alias("path"), g(2).cast("int").alias("s"), g(3).cast("int").alias("e"))


@query(f"WITH {TEXTS} SELECT file_id, length(regexp_replace(content, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')) AS n FROM tx")
def nonspace_len(spark, d):
    return texts(spark, d).select("file_id", T.nonspace_length(F.col("content")).alias("n"))


@query(f"WITH {TEXTS} SELECT file_id, length(h) - length(replace(h, chr(10), '')) + 1 AS line FROM (SELECT file_id, content[:CAST(floor(length(content) / 2) AS INT)] AS h FROM tx)")
def byte_to_line(spark, d):
    return texts(spark, d).select("file_id", T.line_of_offset(F.col("content"), F.floor(F.length("content") / 2).cast("int")).alias("line"))


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH {TEXTS}, ar AS (SELECT file_id, string_split(content, chr(10)) AS a FROM tx), st AS (SELECT file_id, a, unnest(range(0, len(a), {step})) AS s FROM ar)
SELECT file_id, s AS start, least(s + {size}, len(a)) AS "end", md5(array_to_string(list_slice(a, s + 1, s + {size}), chr(10))) AS digest FROM st"""


@query(_windows_sql(30, 15))
def chunk_fixed_lines(spark, d):
    return N.fixed_windows(texts(spark, d), ["file_id"], "content").select("file_id", "start", "end", F.md5("piece").alias("digest"))


@query(f'SELECT file_id, start + 1 AS start, "end" + 1 AS "end", digest FROM ({_windows_sql(50, 50)})')
def chunk_fallback(spark, d):
    w = N.fixed_windows(texts(spark, d), ["file_id"], "content", 50, 0)
    return w.select("file_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.md5("piece").alias("digest"))


@query(f"WITH {LN} SELECT file_id, i FROM ln WHERE contains(l, 'gateway')")
def grep_literal(spark, d):
    return texts(spark, d).select("file_id", F.explode(N.match_lines(F.col("content"), lambda l: l.contains("gateway"))).alias("i"))


@query(f"WITH {LN} SELECT file_id, i FROM ln WHERE regexp_matches(l, 'return +[a-z]+;?[ \\t]*$')")
def grep_regex(spark, d):
    return texts(spark, d).select("file_id", F.explode(N.match_lines(F.col("content"), lambda l: l.rlike(r"return +[a-z]+;?[ \t]*\z"))).alias("i"))


@query(f"WITH {LN} SELECT file_id, i FROM ln WHERE contains(lower(l), 'gateway')")
def grep_ignore_case(spark, d):
    return texts(spark, d).select("file_id", F.explode(N.match_lines(F.col("content"), lambda l: F.lower(l).contains("gateway"))).alias("i"))


_TRUNC = "CASE WHEN length(t) > 200 THEN t[:97] || ' … ' || t[-97:] || ' (truncated, ' || length(t) || ' chars)' ELSE t END"
_ISL = f"""WITH {LN}, lt AS (SELECT file_id, i, contains(l, 'gateway') AS m, regexp_replace(l, '[ \\t\\r\\f]+$', '') AS t FROM ln),
cx AS (SELECT *, bool_or(m) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lt), kp AS (SELECT * FROM cx WHERE near),
isl AS (SELECT *, sum(CASE WHEN p IS NULL OR i - p >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY file_id ORDER BY i) AS p FROM kp))
SELECT file_id, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last, md5(string_agg({_TRUNC}, chr(10) ORDER BY i)) AS digest, string_agg(CASE WHEN m THEN i END, ',' ORDER BY i) AS matches FROM isl GROUP BY file_id, k"""


@query(_ISL)
def grep_islands(spark, d):
    x = N.islands(texts(spark, d), ["file_id"], "content", lambda l: l.contains("gateway"))
    return x.select("file_id", "first", "last", F.md5("body").alias("digest"), F.array_join(F.transform("matches", lambda m: m.cast("string")), ",").alias("matches"))


@query(f"SELECT file_id, file_path, first, matches FROM ({_ISL.replace("'gateway'", "'return'")}) JOIN tx2 USING (file_id) WHERE file_path LIKE 'src/%' AND NOT regexp_matches(file_path, '(^|/)(vendor|node_modules)/') AND NOT ends_with(file_path, '.rb') AND strlen(content) <= 204800 ORDER BY file_path, file_id, first LIMIT 50".replace("SELECT file_id, file_path", f"WITH tx2 AS (SELECT DISTINCT ON (file_id) file_id, file_path, content FROM repo_files WHERE content IS NOT NULL) SELECT file_id, file_path", 1))
def grep_search(spark, d):
    """The first fifty islands under a directory, outside excluded folders and suffixes, of files that are not too large; an
    empty result is an error."""
    x = N.grep(texts(spark, d), ["file_id"], "file_path", "content", "return", directory="src", exclude_dirs=("vendor", "node_modules"), exclude_suffixes=(".rb",))
    found = N.or_error(x, "no matches for 'return'")
    return found.select("file_id", "file_path", "first", F.array_join(F.transform("matches", lambda m: m.cast("string")), ",").alias("matches"))


@query(f"SELECT file_id, first, CAST(split_part(matches, ',', 1) AS INT) AS line FROM ({_ISL})")
def grep_parse_blocks(spark, d):
    """Blocks as a search tool prints them, `path-n-text` and `path:n:text`, parsed back to their first matching line."""
    x = N.islands(texts(spark, d), ["file_id"], "content", lambda l: l.contains("gateway"))
    x = x.select("file_id", "first", F.transform(F.split("body", "\n"), lambda l, i: F.concat(F.lit("f"), F.when(F.array_contains("matches", i + F.col("first")), ":").otherwise("-"), (i + F.col("first")).cast("string"), F.when(F.array_contains("matches", i + F.col("first")), ":").otherwise("-"), l)).alias("b"))
    hit = F.element_at(F.filter("b", lambda l: l.rlike(r"^f:\d+:")), 1)
    return x.select("file_id", "first", F.regexp_extract(hit, r"^f:(\d+):", 1).cast("int").alias("line"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{k}'" for p, k in N.CODE_PATTERNS) + " END"


@query(f"WITH {LN}, k AS (SELECT file_id, i, l, {_KIND} AS kind FROM ln) SELECT file_id, i, kind, i || ': ' || l AS shown FROM k WHERE kind IS NOT NULL AND trim(l) <> '' AND NOT starts_with(ltrim(l), '#') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i) <= 200")
def summarize_code_regex(spark, d):
    return N.summarize_code(texts(spark, d), ["file_id"], "content")


_MARK = "trim(l) <> '' AND regexp_matches(l, '^#{1,6}\\s+|^\\s*[-*+]\\s+|^\\s*\\d+\\.\\s+')"


@query(
    f"""WITH ar AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), ln AS (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS i, len(a) AS n FROM ar),
k AS (SELECT *, ({_MARK}) AS m FROM ln), c AS (SELECT *, count(*) FILTER (m) OVER (PARTITION BY doc_id) AS nm FROM k),
f AS (SELECT * FROM c WHERE NOT m AND trim(l) <> '' AND nm < 40 AND (i - 1) % greatest(1, n // greatest(40 - nm, 1)) = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 40 - nm)
SELECT doc_id, i, i || ': ' || l AS shown FROM k WHERE m UNION ALL SELECT doc_id, i, i || ': ' || l FROM f"""
)
def summarize_text(spark, d):
    x = read(spark, d, "documents").where("text is not null")
    return N.summarize_text(x, ["doc_id"], "text", 40)


_SMP = f"WITH {TEXTS}, n AS (SELECT file_id, len(string_split(content, chr(10))) AS n FROM tx), st AS (SELECT file_id, n, CASE WHEN n > 60 THEN n // 60 ELSE 1 END AS k FROM n), s AS (SELECT file_id, n, unnest(range(1, n + 1, k)[:60]) AS i FROM st)"


@query(f"{_SMP} SELECT file_id, i FROM s")
def interval_sample(spark, d):
    return N.sample_lines(texts(spark, d), ["file_id"], "content", 60)


@query(f"{_SMP} SELECT s.file_id, s.i, md5(a.l) AS digest FROM s JOIN (SELECT file_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT file_id, string_split(content, chr(10)) AS a FROM tx)) a USING (file_id, i)")
def summarize_sample(spark, d):
    x = texts(spark, d)
    i = N.sample_lines(x, ["file_id", "content"], "content", 60)
    return i.select("file_id", "i", F.md5(F.get(T.lines(F.col("content")), F.col("i") - 1)).alias("digest"))


@query(f"{_SMP}, nx AS (SELECT *, lead(i) OVER (PARTITION BY file_id ORDER BY i) AS nxt FROM s) SELECT file_id, i + 1 AS first, coalesce(nxt - 1, n) AS last FROM nx WHERE i + 1 <= coalesce(nxt - 1, n)")
def skipped_ranges(spark, d):
    return N.skipped(texts(spark, d), ["file_id"], "content", 60)


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def case_sql(expr: str, table: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


BASE = "regexp_extract(file_path, '[^/]*$')"
_EXT, _ALL_EXT = f"lower(regexp_extract({BASE}, '^.+(\\.[^.]*)$', 1))", f"lower(regexp_extract({BASE}, '^\\.*[^.]+((\\.[^.]+)+)$', 1))"
_TYPE = f"""CASE WHEN {_EXT} IN {in_sql(L.CODE_SUFFIXES)} OR lower({BASE}) IN ('dockerfile', 'makefile') THEN 'code' WHEN {_EXT} IN {in_sql(L.TEXT_SUFFIXES)} THEN 'text'
WHEN {_EXT} IN {in_sql(L.CONFIG_SUFFIXES)} OR starts_with(lower({BASE}), '.env') THEN 'config' WHEN content[:1000] = '' THEN 'unknown'
WHEN regexp_matches(content[:1000], '{L.CODE_LOOK}') THEN 'code' WHEN regexp_matches(content[:1000], '{L.CONFIG_LOOK}') THEN 'config' ELSE 'unknown' END"""
_IGNORED = f"(len(list_intersect(string_split(file_path, '/'), [{in_sql(L.IGNORED_PARTS)[1:-1]}])) > 0 OR {_EXT} IN {in_sql(L.BINARY_SUFFIXES)})"
PARSED = f"coalesce({case_sql(f'lower({BASE})', L.PARSED_NAMES)}, {case_sql("CASE WHEN contains(file_path, '.') THEN lower(regexp_extract(file_path, '[^.]*$')) END", L.PARSED_SUFFIXES)})"


@query(f"WITH {TEXTS} SELECT file_id, {_TYPE} AS kind FROM tx")
def detect_file_type(spark, d):
    return texts(spark, d).select("file_id", L.file_type(F.col("file_path"), F.left("content", F.lit(1000))).alias("kind"))


@query(
    f"""WITH {TEXTS}, k AS (SELECT file_id, {_TYPE} AS kind, {_IGNORED} AS ign, size_bytes, len(string_split(content, chr(10))) > 1000 AS long FROM tx)
SELECT file_id, CASE WHEN ign THEN 'not supported' WHEN size_bytes > 52428800 THEN 'too large' WHEN kind IN ('code', 'text') THEN kind ELSE 'sampling' END AS kind, long AS "summarize" FROM k"""
)
def summarize_dispatch(spark, d):
    """How every file is summarised, those without a suffix by their content, and whether it is long enough to be."""
    x, c = texts(spark, d), F.col("content")
    return x.select("file_id", L.summary_kind(F.col("file_path"), F.left(c, F.lit(1000)), F.col("size_bytes")).alias("kind"), (F.size(T.lines(c)) > L.SUMMARY_FROM_LINES).alias("summarize"))


@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE len(string_split(content, chr(10))) > 1000")
def should_summarize(spark, d):
    return texts(spark, d).where(F.size(T.lines(F.col("content"))) > L.SUMMARY_FROM_LINES).select("file_id")


@query(f"SELECT DISTINCT file_path, coalesce({case_sql(BASE, L.SPECIAL_FILES)}, {case_sql(_ALL_EXT, L.SUFFIXES)}, {case_sql(_EXT, L.SUFFIXES)}, 'unknown') AS language FROM repo_files")
def guess_language(spark, d):
    return read(spark, d, "repo_files").select("file_path", L.guess_language(F.col("file_path")).alias("language")).distinct()


@query(f"SELECT DISTINCT file_path, {PARSED} AS language FROM repo_files")
def language_by_suffix(spark, d):
    return read(spark, d, "repo_files").select("file_path", L.parser_language(F.col("file_path")).alias("language")).distinct()


_IMP = f"""WITH {LN}, k AS (SELECT file_id, i, CASE WHEN regexp_matches(l, '^\\s*(import|from|require|package)\\b') THEN 1 WHEN trim(translate(l, E'\\t\\r', '  ')) = '' OR regexp_matches(trim(translate(l, E'\\t\\r', '  ')), '^(#|//|/\\*|\\*|--)') THEN 0 ELSE 2 END AS k FROM ln),
g AS (SELECT file_id, i, k, count(*) FILTER (k = 2) OVER (PARTITION BY file_id ORDER BY i) AS b FROM k) SELECT file_id, min(i) AS first, max(i) AS last, count(*) AS n FROM g WHERE k = 1 GROUP BY file_id, b"""


@query(_IMP)
def import_block_merge(spark, d):
    return N.import_blocks(texts(spark, d), ["file_id"], "content").withColumn("n", F.col("n").cast("bigint"))


_DECL = r"^\s*(export\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|async\s+)*(class|interface|def|func|fun|function)\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)"


@query(f"WITH {LN} SELECT file_id, i, CASE WHEN regexp_extract(l, '{_DECL}', 2) IN ('class', 'interface') THEN 'class' ELSE 'function' END AS kind, regexp_extract(l, '{_DECL}', 4) AS name FROM ln WHERE regexp_matches(l, '{_DECL}')")
def declared_lines(spark, d):
    """Classes and functions by their first line, whatever the language: what a pattern sees."""
    return N.declarations(texts(spark, d), ["file_id"], "content")


@query(f"WITH {LN}, dc AS (SELECT file_id, i, regexp_extract(l, '{_DECL}', 2) IN ('class', 'interface') AS c, regexp_extract(l, '{_DECL}', 4) AS name FROM ln WHERE regexp_matches(l, '{_DECL}')) SELECT file_id, i, name, last_value(CASE WHEN c THEN name END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM dc")
def symbol_parents(spark, d):
    """The nearest class declared before each symbol."""
    w = Window.partitionBy("file_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return declared_lines(spark, d).select("file_id", "i", "name", F.last(F.when(F.col("kind") == "class", F.col("name")), ignorenulls=True).over(w).alias("parent"))


@query(f"WITH {LN}, dc AS (SELECT file_id, i FROM ln WHERE regexp_matches(l, '{_DECL}')), t AS (SELECT file_id, i, trim(translate(l, E'\\t\\r', '  ')) AS t FROM ln), s AS (SELECT file_id, i FROM t WHERE NOT (t = '' OR regexp_matches(t, '^(#|//|/\\*|\\*|--|@)'))) SELECT file_id, i, coalesce((SELECT max(s.i) FROM s WHERE s.file_id = dc.file_id AND s.i < dc.i), 0) + 1 AS start FROM dc")
def decorator_expand(spark, d):
    """Symbols with their start moved up over decorators, blank and comment lines."""
    code = lambda l: ~(T.is_comment_or_blank(l) | F.ltrim(F.translate(l, "\t\r", "  ")).startswith("@"))
    x = texts(spark, d).withColumn("solid", N.match_lines(F.col("content"), code))
    s = N.declarations(x, ["file_id", "solid"], "content")
    return s.select("file_id", "i", (F.coalesce(F.array_max(F.filter("solid", lambda k: k < F.col("i"))), F.lit(0)) + 1).alias("start"))


_SPAN = f"{SYMBOLS}, r AS (SELECT file_id, start_line AS s, max(end_line) AS e FROM sy WHERE file_id > 0 AND start_line >= 1 AND end_line >= start_line GROUP BY ALL)"


def _spans(spark, d):
    x = symbols(spark, d).where("file_id > 0 and start_line >= 1 and end_line >= start_line")
    return x.groupBy("file_id", F.col("start_line").alias("s")).agg(F.max("end_line").alias("e"))


@query(f"WITH {_SPAN} SELECT file_id, s, coalesce(lead(s) OVER (PARTITION BY file_id ORDER BY s), max(e) OVER (PARTITION BY file_id)) AS e FROM r")
def legacy_fill_gaps(spark, d):
    """Each span ends where the next begins, the last at the end of what is known of the file."""
    w = Window.partitionBy("file_id").orderBy("s")
    return _spans(spark, d).select("file_id", "s", F.coalesce(F.lead("s").over(w), F.max("e").over(Window.partitionBy("file_id"))).alias("e"))


@query(f"WITH {_SPAN}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s DESC) AS z, lead(e - s) OVER (PARTITION BY file_id ORDER BY s) AS nxt, lead(e) OVER (PARTITION BY file_id ORDER BY s) AS ne, count(*) OVER (PARTITION BY file_id) AS n FROM r) SELECT file_id, s, CASE WHEN z = 2 AND nxt < 5 THEN ne ELSE e END AS e FROM k WHERE NOT (z = 1 AND n > 1 AND e - s < 5)")
def legacy_finalize(spark, d):
    """A last span under five lines joins the one before."""
    w, back = Window.partitionBy("file_id").orderBy("s"), Window.partitionBy("file_id").orderBy(F.desc("s"))
    k = _spans(spark, d).select("file_id", "s", "e", F.row_number().over(back).alias("z"), F.lead(F.col("e") - F.col("s")).over(w).alias("nxt"), F.lead("e").over(w).alias("ne"), F.count("*").over(Window.partitionBy("file_id")).alias("n"))
    e = F.when((F.col("z") == 2) & (F.col("nxt") < 5), F.col("ne")).otherwise(F.col("e"))
    return k.where(~((F.col("z") == 1) & (F.col("n") > 1) & (F.col("e") - F.col("s") < 5))).select("file_id", "s", e.alias("e"))


@query(f"WITH {_SPAN} SELECT file_id, count(*) AS n_overlaps FROM (SELECT file_id, e, lead(s) OVER (PARTITION BY file_id ORDER BY s) AS ns FROM r) WHERE ns < e GROUP BY 1")
def overlap_check(spark, d):
    w = Window.partitionBy("file_id").orderBy("s")
    return _spans(spark, d).withColumn("ns", F.lead("s").over(w)).where("ns < e").groupBy("file_id").agg(F.count("*").alias("n_overlaps"))


@query(f"WITH {LN}, w AS (SELECT file_id, i, length(l) - length(ltrim(translate(l, chr(9), ' '))) AS w FROM ln) SELECT file_id, string_agg(x, ',' ORDER BY i) AS deltas FROM (SELECT file_id, i, w - coalesce(lag(w) OVER (PARTITION BY file_id ORDER BY i), 0) AS x FROM w) GROUP BY 1")
def relative_indent(spark, d):
    x = texts(spark, d).select("file_id", T.lines(F.col("content")).alias("a"))
    x = x.select("file_id", F.transform("a", lambda l: F.length(l) - F.length(F.ltrim(F.translate(l, "\t", " ")))).alias("w"))
    prev = F.concat(F.array(F.lit(0)), F.slice("w", F.lit(1), F.size("w") - 1))
    return x.select("file_id", F.array_join(F.transform(F.zip_with("w", prev, lambda a, b: a - b), lambda v: v.cast("string")), ",").alias("deltas"))


@query(f"WITH {TEXTS}, tk AS (SELECT file_id, len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS n FROM tx) SELECT file_id, n AS n_tokens, n > 100000 AS over FROM tk")
def token_limit_check(spark, d):
    """Tokens of a payload against the usual limit; words stand for tokens where no tokenizer is given."""
    n = F.size(T.words(F.col("content")))
    return texts(spark, d).select("file_id", n.alias("n_tokens"), (n > 100_000).alias("over"))


@query(f"WITH {TEXTS} SELECT CAST(sum(len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'))) AS BIGINT) AS total FROM tx")
def token_totals(spark, d):
    return texts(spark, d).agg(F.sum(F.size(T.words(F.col("content")))).alias("total"))


@query(f"WITH {TEXTS} SELECT file_id, md5(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS digest FROM tx")
def normalize_eol(spark, d):
    return texts(spark, d).select("file_id", F.md5(T.lf_only(F.col("content"))).alias("digest"))


@query()
def fuzzy_path(spark, d):
    """The first hundred paths with a part that is similar enough to the term, outside hidden and ignored folders, and how
    many more there are; each distinct part is compared once."""
    from corpusmill.operators.fuzzy import fuzzy_paths

    x = read(spark, d, "repo_files").select("file_id", "file_path").distinct().where(~L.pruned(F.col("file_path"), set(L.IGNORED_PARTS), []))
    near = fuzzy_paths(x, "file_id", "file_path", "gatway").join(x, "file_id").select("file_path", "file_id", "best")
    return L.capped(near, ["file_path", "file_id"], 100)


@query(f"WITH {SAMPLES}, {TEXTS} SELECT ck.id, md5(array_to_string(list_slice(string_split(content, chr(10)), s, e), chr(10))) AS digest FROM ck JOIN tx USING (file_id) WHERE fn IS NOT NULL AND s >= 1 AND e >= s")
def autocomplete_read(spark, d):
    j = samples(spark, d).where("fn is not null and s >= 1 and e >= s").join(texts(spark, d).select("file_id", "content"), "file_id")
    return j.select("id", F.md5(T.line_range(F.col("content"), F.col("s"), F.col("e"))).alias("digest"))


@query("SELECT DISTINCT repo_path, 'example.org' AS host, 'team' || replace(regexp_replace(repo_path, '/[^/]*$', ''), '//', '/') AS owner, regexp_extract(repo_path, '[^/]*$') AS repo FROM repo_files")
def remote_url_parts(spark, d):
    """Addresses made of the repositories' paths, taken apart again."""
    x = read(spark, d, "repo_files").select("repo_path").distinct()
    x = x.withColumn("p", L.remote_parts(F.concat(F.lit("git@example.org:team"), "repo_path", F.lit(".git"))))
    return x.select("repo_path", "p.host", "p.owner", "p.repo")


@query(f"WITH {LN} SELECT file_id, count(*) FILTER (t = '' OR regexp_matches(t, '^(#|//|/\\*|\\*|--)')) AS n FROM (SELECT file_id, trim(translate(l, E'\\t\\r', '  ')) AS t FROM ln) GROUP BY 1")
def blank_or_comment_lines(spark, d):
    hit = N.match_lines(F.col("content"), T.is_comment_or_blank)
    return texts(spark, d).select("file_id", F.size(hit).alias("n"))


@query(f"WITH {LN} SELECT file_id, count(*) FILTER (regexp_matches(l, '^[ \\t]*[)}}\\]]')) AS n FROM ln GROUP BY 1")
def starts_with_closing_delimiter(spark, d):
    return texts(spark, d).select("file_id", F.size(N.match_lines(F.col("content"), lambda l: l.rlike(r"^[ \t]*[)}\]]"))).alias("n"))


@query(f"WITH {TEXTS} SELECT file_id, md5(regexp_replace(regexp_replace(content, '\\A([ \\t\\r]*\\n)+', ''), '(\\n[ \\t\\r]*)+\\z', '')) AS digest FROM tx")
def trim_blank_lines(spark, d):
    return texts(spark, d).select("file_id", F.md5(T.trimmed_blank_lines(F.col("content"))).alias("digest"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '{\"value\":\"' || event_type || '\"}' END AS args FROM events")
def tool_arguments(spark, d):
    """JSON arguments kept, plain ones wrapped."""
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", L.json_arguments(raw).alias("args"))
