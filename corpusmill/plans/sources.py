"""Queries of source chunking and text edits: row-wise folds that SQL does not express."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from corpusmill.functions import lang as L
from corpusmill.operators import chunking as C, edits as E, store as S, trees as T
from corpusmill.session import read, scratch

from .general import ORACLE as GENERAL
from .lines import PARSED, case_sql
from .tables import CUT, SYMBOLS, TEXTS, symbols, texts, versions

_NAME = "regexp_extract(replace(file_path, '\\', '/'), '[^/]*$')"
_P1 = GENERAL["p1_found"]
ORACLE = {"incremental_index": f"SELECT * FROM ({_P1}) WHERE run_id = (SELECT max(run_id) FROM ({_P1}))"}


def _sources(spark, d):
    return texts(spark, d).withColumn("lang", L.parser_language(F.col("file_path")))


def chunk_source(spark, d):
    """Sources by their language's strategy."""
    return C.chunk_source(_sources(spark, d), "file_id", "content", "lang")


def strategy_factory(spark, d):
    """Which strategy each language of the corpus gets, and for how many files."""
    lang = F.col("lang")
    how = F.when(lang.isin(*C.GRAMMARS), C.strategy_of("java")).when(lang.isin(*C.PARSERS), "legacy").otherwise("lines")
    return _sources(spark, d).groupBy(lang.alias("language"), how.alias("strategy")).agg(F.count("*").alias("n_files"))


ORACLE["strategy_factory"] = f"""WITH {TEXTS}, l AS (SELECT {PARSED} AS language FROM tx)
SELECT language, CASE WHEN language IN ('python', 'javascript', 'typescript', 'tsx', 'java', 'kotlin', 'ruby', 'swift') THEN 'structure' ELSE 'lines' END AS strategy, count(*) AS n_files FROM l GROUP BY ALL"""


def grammars(spark, d):
    """Node types by language and role."""
    rows = [(lang, role, t) for lang, g in C.GRAMMARS.items() for role, ts in g.roles().items() for t in sorted(ts)]
    return spark.createDataFrame(rows, "language string, role string, node_type string")


def _per_text(df, key, text, fn, schema):
    return C.per_text(df, key, text, None, lambda t, _: fn(t), schema)


def _per_tree(spark, d, fn, schema):
    """fn(tree, grammar, text) -> rows, of every source that has a tree."""

    def run(t, lang):
        root = C.tree_of(t, lang) if lang in C.GRAMMARS else None
        return fn(root, C.GRAMMARS[lang], t) if root else []

    return C.per_text(_sources(spark, d), "file_id", "content", "lang", run, schema)


def chunk_metadata_ast(spark, d):
    """Spans along the trees of the sources, before merging."""

    def spans(root, g, t):
        return [(s.start[0] + 1, s.end[0] + 1, s.size, len(s.hierarchy), s.dechunk, s.import_only) for s in C.tree_spans(root, g, 1200, t.split("\n")).spans]

    return _per_tree(spark, d, spans, "start int, end int, size int, depth int, dechunk boolean, import_only boolean")


def dechunk_merge(spark, d):
    """The same spans after merging."""

    def spans(root, g, t):
        return [(s.start[0] + 1, s.end[0] + 1, s.size) for s in C.merge_spans(C.tree_spans(root, g, 1200, t.split("\n")).spans, 1200)]

    return _per_tree(spark, d, spans, "start int, end int, size int")


def breakable_hierarchy(spark, d):
    """All that is named in each source, in the order of the text."""

    def names(root, g, t):
        return [(i, k, n) for i, (k, n) in enumerate(C.mentions(root, g))]

    return _per_tree(spark, d, names, "ord int, kind string, name string")


def legacy_coalesce(spark, d):
    """Byte spans of the structure-blind strategy, joined to spans of enough substance."""

    def spans(root, g, t):
        return C.coalesced(C.byte_spans(root, 1200), t.encode("utf-8", "surrogatepass"))

    return _per_tree(spark, d, spans, "start_byte bigint, end_byte bigint")


def chunk_legacy(spark, d):
    """Chunks of the structure-blind strategy."""
    return C.chunk_source(_sources(spark, d), "file_id", "content", "lang", by_structure=False).select("file_id", "start", "end")


def chunk_pr_diff(spark, d):
    """Documents as change sets: number and sizes of their pieces."""
    return _per_text(read(spark, d, "documents"), "doc_id", "text", lambda t: [(i, len(p)) for i, p in enumerate(C.diff_pieces(t, 200))], "piece int, n_chars int")


def token_bin_pack(spark, d):
    """Batches of texts up to 2,048 words each, in the order of each task's rows; the task's partition is part of a batch's
    number, and a batch goes on over Arrow batches."""
    kept = read(spark, d, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n"))

    def run(batches):
        number, total = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            numbers = []
            for n in b["n"].tolist():
                if total and total + n > 2048:
                    number, total = number + 1, 0
                total += n
                numbers.append(number)
            yield pd.DataFrame({"doc_id": b["doc_id"], "batch": numbers, "n": b["n"]})

    return kept.mapInPandas(run, "doc_id bigint, batch bigint, n int")


def _edits(spark, d, kind, diff):
    return E.apply_edits(texts(spark, d).select("file_id", "content", F.lit(kind).alias("kind"), diff.alias("diff")), "file_id")


def apply_search_replace(spark, d):
    """The first line of every source replaced by one that is marked."""
    first = F.element_at(F.split("content", "\n"), 1)
    diff = F.concat(F.lit("--- SEARCH\n"), first, F.lit("\n===\n"), first, F.lit(" # edited\n+++ REPLACE"))
    return _edits(spark, d, "search_and_replace", diff).select("file_id", F.md5("content").alias("digest"), "errors")


def apply_udiff(spark, d):
    """A line put before the first line of every source by a unified diff."""
    first = F.element_at(F.split("content", "\n"), 1)
    diff = F.concat(F.lit("@@ -1,1 +1,2 @@\n+marked\n "), first, F.lit("\n"))
    return _edits(spark, d, "unified", diff).select("file_id", F.md5("content").alias("digest"), "errors")


def apply_line_numbered(spark, d):
    """Lines two to three of every source replaced."""
    return _edits(spark, d, "line_numbered", F.lit('[[2, 3, "replaced\\n"]]')).select("file_id", F.md5("content").alias("digest"), "errors")


def normalize_hunk(spark, d):
    """Hunks made of each source's first lines, one of them changed, written twice and with another context width: once."""

    def one(t):
        lines = t.split("\n")[:4]
        hunk = [" " + lines[0], "-" + (lines[1] if len(lines) > 1 else ""), "+changed", *(" " + x for x in lines[2:])]
        return [(len(E.distinct_hunks([hunk, list(hunk), [" same"]])), len(E.normalised(hunk)))]

    return _per_text(texts(spark, d), "file_id", "content", one, "n_hunks int, n_lines int")


def hunk_before_after(spark, d):
    """Documents that are diffs: hunks with the sizes of their old and new sides."""

    def one(t):
        return [(len(a), len(b)) for a, b in map(E.before_after, E.hunks(t))] if t.startswith("@@") or "\n@@" in t else []

    return _per_text(read(spark, d, "documents"), "doc_id", "text", one, "n_before int, n_after int")


def node_classifiers(spark, d):
    """Nodes of each source by role."""

    def roles(root, g, t):
        n, todo = dict.fromkeys(("class", "function", "namespace", "breakable"), 0), [root]
        while todo:
            x = todo.pop()
            n["class"] += T.is_class(x, g)
            n["function"] += T.is_function(x, g)
            n["namespace"] += T.is_namespace(x, g)
            n["breakable"] += T.is_breakable(x, g)
            todo += x.children
        return list(n.items())

    return _per_tree(spark, d, roles, "role string, n int")


def extract_symbols(spark, d):
    """Classes, functions and blocks of imports of each source, with the class around a function."""
    return C.per_text(_sources(spark, d), "file_id", "content", "lang", C.symbols_of, C.SYMBOL)


def symbol_name(spark, d):
    """Names of the symbols by their first line; nodes without a name are 'unnamed'."""
    return extract_symbols(spark, d).where("category in ('class', 'function')").select("file_id", F.col("start_line").alias("line"), F.col("node_name").alias("name"))


def summarize_code_ast(spark, d):
    """Signatures of classes and functions, and imports, of each source with a tree."""
    return C.per_text(_sources(spark, d), "file_id", "content", "lang", lambda t, lang: C.outline(t, lang) or [], "line int, shown string")


def categorize_symbol(spark, d):
    """Category of each stored symbol by its node type in its file's language; the wrapper around decorators has none."""
    rows = [(lang, t, kind) for kind, table in (("class", C.SYMBOL_CLASSES), ("function", C.SYMBOL_FUNCTIONS), ("import", C.SYMBOL_IMPORTS)) for lang, ts in table.items() for t in ts]
    table = spark.createDataFrame(rows, "language string, node_type string, kind string")
    lang = read(spark, d, "files").groupBy(F.col("id").alias("file_id")).agg(F.max(L.guess_language(F.translate("file_path", "\\", "/"))).alias("language"))
    sy = symbols(spark, d).join(lang, "file_id").join(F.broadcast(table), ["language", "node_type"], "left")
    kind = F.when(F.col("node_type") == "import_block", "import").otherwise(F.col("kind"))
    return sy.groupBy("language", kind.alias("kind")).agg(F.count("*").alias("n"))


_KINDS = ", ".join(f"('{lang}', '{t}', '{kind}')" for kind, table in (("class", C.SYMBOL_CLASSES), ("function", C.SYMBOL_FUNCTIONS), ("import", C.SYMBOL_IMPORTS)) for lang, ts in table.items() for t in sorted(ts))
ORACLE["categorize_symbol"] = f"""WITH {SYMBOLS}, f AS (SELECT id, max(coalesce({case_sql(_NAME, L.SPECIAL_FILES)}, {case_sql(f"lower(regexp_extract({_NAME}, '^[.]*[^.]+(([.][^.]+)+)$', 1))", L.SUFFIXES)},
  {case_sql(f"lower(regexp_extract({_NAME}, '^.+([.][^.]*)$', 1))", L.SUFFIXES)}, 'unknown')) AS language FROM files GROUP BY 1),
k AS (SELECT language, CASE WHEN sy.node_type = 'import_block' THEN 'import' ELSE t.kind END AS kind FROM sy JOIN f ON f.id = sy.file_id LEFT JOIN (VALUES {_KINDS}) t(l, nt, kind) ON t.l = language AND t.nt = sy.node_type)
SELECT language, kind, count(*) AS n FROM k GROUP BY ALL"""


def sync_repo_state(spark, d):
    """The symbol store brought from an earlier state of the feed to the present one: files that went or changed are
    deleted with their symbols, new and changed ones are inserted and their texts cut up. What the store then holds."""
    now, before = versions(spark, d), versions(spark, d, CUT)
    keys = ["repo_path", "file_path"]
    moved = S.diff(now, before, keys, "file_hash")
    gone = before.join(moved.where("action <> 'insert'"), keys, "left_semi").select("id")
    taken = now.join(moved.where("action <> 'delete'"), keys, "left_semi").select("id").distinct()
    old = symbols(spark, d).join(before.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    _, kept = S.cascade_delete(before.select("id"), old, gone, "file_id")
    new = extract_symbols(spark, d).join(taken.withColumnRenamed("id", "file_id"), "file_id", "left_semi").where(F.col("category").isNotNull())
    both = kept.select("file_id", "node_name", "category").withColumn("origin", F.lit("kept")).unionByName(new.select("file_id", "node_name", "category").withColumn("origin", F.lit("new")))
    return both.groupBy("origin", "category").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def parse_search_replace(spark, d):
    """A block made of each source's first lines, parsed back."""
    first = F.array_join(F.slice(F.split("content", "\n"), 1, 3), "\n")
    x = texts(spark, d).select("file_id", F.concat(F.lit("--- SEARCH\n"), first, F.lit("\n===\nnew\n+++ REPLACE\n")).alias("diff"))

    def parsed(t):
        try:
            return [(len(a), len(b)) for a, b in E.parse_blocks(t)]
        except E.EditError:
            return [(-1, -1)]

    return _per_text(x, "file_id", "diff", parsed, "n_search int, n_replace int")


def locate_span(spark, d):
    """Where the trimmed third and fourth line of each source are found again."""

    def found(t):
        lines = t.split("\n")
        span = E.locate(lines, [x.strip() for x in lines[2:4]])
        return [span] if span else []

    return _per_text(texts(spark, d), "file_id", "content", found, "first int, behind int")


def flexible_search_replace(spark, d):
    """The second and third line of each source replaced by two others, found also where their indents are given relative."""

    def one(t):
        lines = t.split("\n")
        if len(lines) < 3 or not "".join(lines[1:3]).strip():
            return []
        got = E.flexible_replace(t, "\n".join(lines[1:3]) + "\n", "new\nlines\n")
        return [(-1 if got is None else len(got),)]

    return _per_text(texts(spark, d), "file_id", "content", one, "n_chars int")


def search_replace_trimmed(spark, d):
    """The second line of each source replaced although its indent is not given."""

    def one(t):
        lines = t.split("\n")
        if len(lines) < 2:
            return []
        try:
            return [(len(E.search_replace(t, f"--- SEARCH\n{lines[1].strip()}\n===\nnew line\n+++ REPLACE\n")), None)]
        except E.EditError as e:
            return [(-1, str(e)[:20])]

    return _per_text(texts(spark, d), "file_id", "content", one, "n_chars int, error string")


def parse_udiff_hunks(spark, d):
    """Documents that are diffs: their hunks, each once."""
    return _per_text(read(spark, d, "documents"), "doc_id", "text", lambda t: [(i, len(h)) for i, h in enumerate(E.hunks(t))] if t.startswith("@@") or "\n@@" in t else [], "hunk int, n_lines int")


def apply_hunk(spark, d):
    """The hunks of documents that are diffs, applied to their own old sides: nothing is left over."""

    def one(t):
        if not (t.startswith("@@") or "\n@@" in t):
            return []
        old = "\n".join(x for h in E.hunks(t) for x in E.before_after(h)[0]) + "\n"
        return [(len(E.unified(old, t)[1]),)]

    return _per_text(read(spark, d, "documents"), "doc_id", "text", one, "n_errors int")


def diff_dispatch(spark, d):
    """All three kinds of edits in one table, each row by the runner of its kind."""
    first = F.element_at(F.split("content", "\n"), 1)
    k = F.col("file_id") % 3
    kind = F.when(k == 0, "search_and_replace").when(k == 1, "unified").otherwise("line_numbered")
    diff = F.when(k == 0, F.concat(F.lit("--- SEARCH\n"), first, F.lit("\n===\n"), first, F.lit(" # edited\n+++ REPLACE"))).when(k == 1, F.concat(F.lit("@@ -1,1 +1,2 @@\n+marked\n "), first, F.lit("\n"))).otherwise(F.lit('[[1, 1, "replaced\\n"]]'))
    rows = texts(spark, d).select("file_id", "content", kind.alias("kind"), diff.alias("diff"))
    return E.apply_edits(rows, "file_id").select("file_id", F.md5("content").alias("digest"), "errors")


def incremental_index(spark, d):
    """The changes of the last succeeded run: what an index has to take up next."""
    from .general import p1_found

    x = p1_found(spark, d)
    return x.join(F.broadcast(x.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


def schema_version_gate(spark, d):
    """A store of files and chunks of another version, or forced, is made anew; one of the right version stays."""
    rows, folder = [], scratch(spark)
    try:
        for tbl in ("files", "chunks"):
            for i, (version, force) in enumerate([(18, False), (19, False), (19, False), (19, True)]):
                rows.append((tbl, i, S.ensure_schema(spark, f"{folder}/{tbl}", version, lambda: read(spark, d, tbl), force=force)))
    finally:
        S.drop_all(spark, folder)
    return spark.createDataFrame(rows, "tbl string, step int, recreated boolean")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_source, strategy_factory, grammars, chunk_metadata_ast, dechunk_merge, breakable_hierarchy, legacy_coalesce, chunk_legacy, chunk_pr_diff, token_bin_pack, apply_search_replace, apply_udiff, apply_line_numbered, hunk_before_after,
        node_classifiers, extract_symbols, categorize_symbol, sync_repo_state, symbol_name, summarize_code_ast, parse_search_replace, locate_span, flexible_search_replace, search_replace_trimmed, normalize_hunk, parse_udiff_hunks, apply_hunk, diff_dispatch, incremental_index, schema_version_gate,
    )
}
