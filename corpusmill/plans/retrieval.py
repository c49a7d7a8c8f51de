"""Queries of retrieval: tokens, scores, vectors, hybrid, keyword, rerank."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import search as S
from corpusmill.session import checkpoint, read, small

from . import indexes
from .tables import BM25, CUR, SAMPLES, TOKENS, bm25_sql, query_sql, samples, versions

QUERY = "retry policy of the search tool and the stale gatewayAdapter"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return read(spark, d, "documents").where(F.col("text").isNotNull())


def _bm(spark, d):
    """doc_id, score from the stored index."""
    index = indexes.documents(spark, d)
    return index.bm25({0: S.counted_terms(spark, QUERY)}).select(F.col("key").alias("doc_id"), "score")


_Q = _QQ = query_sql(QUERY)


@query(f"WITH {TOKENS} SELECT doc_id, array_to_string(u, ' ') AS tokens FROM tk")
def tokenize_identifiers(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.identifier_tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {TOKENS} SELECT doc_id, term, tf FROM post")
def term_freq(spark, d):
    return S.postings(read(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {TOKENS} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY 1")
def doc_length(spark, d):
    return S.postings(read(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.sum("tf").alias("dl"))


@query(f"WITH {TOKENS} SELECT (SELECT count(*) FROM documents) AS n_docs, round((SELECT sum(tf) FROM post) / (SELECT count(*) FROM documents), 6) AS avgdl")
def avg_doc_length(spark, d):
    x = read(spark, d, "documents")
    return S.collection_stats(S.postings(x, "doc_id", "text"), x, "doc_id").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {TOKENS} SELECT term, count(*) AS df FROM post GROUP BY 1")
def doc_freq(spark, d):
    return S.postings(read(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {TOKENS} SELECT doc_id, array_to_string(list_slice(l, len(u) + 1, len(l)), ' ') AS bigrams FROM (SELECT doc_id, l, u FROM ub)")
def bigrams(spark, d):
    u = docs(spark, d).select("doc_id", T.identifier_tokens(F.col("text")).alias("u"))
    return u.select("doc_id", F.array_join(T.joined_runs(F.col("u"), 2), " ").alias("bigrams"))


@query(f"WITH {TOKENS} SELECT tk.doc_id, array_to_string(list_slice(t, len(l) + 1, len(t)), ' ') AS trigrams FROM tk JOIN (SELECT doc_id, l FROM ub) b USING (doc_id)")
def trigrams(spark, d):
    u = docs(spark, d).select("doc_id", T.identifier_tokens(F.col("text")).alias("u"))
    both = u.select("doc_id", F.concat("u", T.joined_runs(F.col("u"), 2)).alias("l"))
    return both.select("doc_id", F.array_join(T.joined_runs(F.col("l"), 3), " ").alias("trigrams"))


@query(f"WITH {TOKENS}, {_Q} SELECT doc_id, term, tf, qtf FROM post JOIN qt USING (term)")
def join_postings_query(spark, d):
    return S.postings(read(spark, d, "documents"), "doc_id", "text").join(F.broadcast(S.query_terms(spark, QUERY)), "term")


@query(f"WITH {TOKENS}, {_Q}, {BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_score(spark, d):
    return _bm(spark, d).select("doc_id", F.round("score", 6).alias("score"))


_LEX = f"""WITH {TOKENS}, {_Q}, {BM25}, best AS (SELECT coalesce(source, '?') || '/' || coalesce(repo_path, '?') AS title, max(score) AS score FROM bm JOIN documents USING (doc_id) GROUP BY 1),
mm AS (SELECT title, score, CASE WHEN min(score) OVER () < max(score) OVER () THEN min(score) OVER () ELSE 0 END AS lo, max(score) OVER () AS hi FROM best)"""


@query(f"{_LEX} SELECT title, round(score, 6) AS score FROM best")
def dedup_title_max(spark, d):
    return S.lexical_search(indexes.documents(spark, d), "title", QUERY).select("title", F.round("score", 6).alias("score"))


@query(f"{_LEX} SELECT title, round((score - lo) / (hi - lo), 6) AS norm FROM mm")
def lexical_search(spark, d):
    return S.lexical_search(indexes.documents(spark, d), "title", QUERY).select("title", F.round("norm", 6).alias("norm"))


_MM = f"""WITH {TOKENS}, {_Q}, {BM25}, lx AS (SELECT doc_id, (score - lo) / (hi - lo) AS norm FROM (SELECT doc_id, score, CASE WHEN min(score) OVER () < max(score) OVER () THEN min(score) OVER () ELSE 0 END AS lo, max(score) OVER () AS hi FROM bm))"""


@query(f"{_MM} SELECT doc_id, round(norm, 6) AS norm FROM lx")
def minmax_norm(spark, d):
    return S.minmax(_bm(spark, d)).select("doc_id", F.round("norm", 6).alias("norm"))


# the query vectors: mean vectors of the labels
_QV = "qv AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1)"


def _query_vectors(spark, d):
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a")).select("label", F.transform("a", lambda x: x["m"]).alias("q"))


@query(f"WITH {_QV} SELECT vec_id, qv.label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cos FROM embeddings CROSS JOIN qv")
def cosine_similarity(spark, d):
    q = small(_query_vectors(spark, d))
    return read(spark, d, "embeddings").drop("label").join(q).select("vec_id", "label", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("cos"))


_VEC = f"{_QV}, vs AS (SELECT vec_id, avg(list_cosine_similarity(embedding::DOUBLE[], q)) AS score FROM embeddings CROSS JOIN qv GROUP BY 1)"


def _vec(spark, d):
    return S.vector_search(read(spark, d, "embeddings"), "vec_id", "embedding", _query_vectors(spark, d), "q")


@query(f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM vs")
def mean_query_similarity(spark, d):
    return _vec(spark, d).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_QV} SELECT count(*) AS n_pairs FROM embeddings CROSS JOIN qv")
def cross_query_text(spark, d):
    return read(spark, d, "embeddings").drop("label").crossJoin(small(_query_vectors(spark, d))).agg(F.count("*").alias("n_pairs"))


@query(f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score FROM vs ORDER BY round(score, 6) DESC, vec_id LIMIT 20")
def vector_search(spark, d):
    return S.top(mean_query_similarity(spark, d), 20, "score", "vec_id")


_HY = f"""{_MM}, {_VEC}, fin AS (SELECT doc_id, lx.norm, vs.score AS vec, CASE WHEN lx.norm IS NOT NULL THEN lx.norm + 3.5 * coalesce(vs.score, 0.04) ELSE 0.02 * coalesce(vs.score, 0.04) END AS final
FROM documents LEFT JOIN lx USING (doc_id) LEFT JOIN vs ON vs.vec_id = documents.doc_id)"""


def _hybrid(spark, d):
    lex = S.minmax(_bm(spark, d)).select("doc_id", "norm")
    return S.native_hybrid(read(spark, d, "documents").select("doc_id"), "doc_id", lex, _vec(spark, d).withColumnRenamed("vec_id", "doc_id"))


@query(f"{_HY} SELECT doc_id, round(final, 6) AS final FROM fin")
def join_hybrid_scores(spark, d):
    return _hybrid(spark, d).select("doc_id", F.round("final", 6).alias("final"))


@query(f"{_HY} SELECT doc_id, round(final, 6) AS final FROM fin ORDER BY round(final, 6) DESC, doc_id LIMIT 60")
def native_hybrid(spark, d):
    return S.top(join_hybrid_scores(spark, d), 60, "final", "doc_id")


@query(ORACLE["native_hybrid"].replace("LIMIT 60", "LIMIT 10"))
def topk_native(spark, d):
    return S.top(join_hybrid_scores(spark, d), 10, "final", "doc_id")


_FU = f"""{_MM}, {_VEC}, vn AS (SELECT vec_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS vn FROM vs),
fu AS (SELECT coalesce(lx.doc_id, vn.vec_id) AS doc_id, 0.7 * coalesce(vn.vn, 0) + 0.3 * coalesce(lx.norm, 0) AS score FROM lx FULL JOIN vn ON vn.vec_id = lx.doc_id)"""


def _fused(spark, d):
    f = S.search("fused", lexical=_bm(spark, d), vector=_vec(spark, d).withColumnRenamed("vec_id", "doc_id"), key="doc_id")
    return f.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_FU} SELECT doc_id, round(score, 6) AS score FROM fu")
def db_hybrid(spark, d):
    return _fused(spark, d)


@query(f"{_FU} SELECT doc_id, round(score, 6) AS score FROM fu ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def topk_hybrid(spark, d):
    return S.top(_fused(spark, d), 20, "score", "doc_id")


@query(f"{_HY} SELECT doc_id, round(final, 6) AS final FROM fin UNION ALL BY NAME SELECT doc_id, round(score, 6) AS final FROM bm ORDER BY final DESC, doc_id LIMIT 15")
def topk_default_chunks(spark, d):
    """Focus and related chunks together, the best by score."""
    both = join_hybrid_scores(spark, d).unionByName(bm25_score(spark, d).withColumnRenamed("score", "final"))
    return S.top(both, 15, "final", "doc_id")


# keyword search over symbols of sample_data
_GRAMS = r"""gr AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(flatten(list_transform(list_filter(regexp_split_to_array(lower(concat_ws(' ', fn, cls, path)), '[^\p{L}\p{N}]+'), lambda w: w <> ''),
  lambda w: CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END))) AS term FROM ck) GROUP BY ALL),
gl AS (SELECT id, sum(tf) AS dl FROM gr GROUP BY 1), gs AS (SELECT count(*) AS n, avg(dl) AS av FROM gl)"""


def _key_sql(word: str, name: str = "kw") -> str:
    grams = ", ".join(f"('{word[i : i + 3].lower()}')" for i in range(len(word) - 2))
    return f"""{name}q AS (SELECT term, count(*) AS qtf FROM (VALUES {grams}) t(term) GROUP BY 1), {name}d AS (SELECT term, count(*) AS df FROM gr JOIN {name}q USING (term) GROUP BY 1),
{name} AS (SELECT id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM gr JOIN {name}q USING (term) JOIN {name}d USING (term) JOIN gl USING (id), gs GROUP BY 1)"""


def _keywords(spark, d, words):
    found = S.keyword_search(samples(spark, d), "id", ["fn", "cls", "path"], indexes.keywords(spark, d), words)
    return found.select(F.col("query").alias("idx"), "id", F.round("score", 6).alias("score"))


@query(f"WITH {SAMPLES}, {_GRAMS}, {_key_sql('Gateway')} SELECT id, round(score, 6) AS score FROM kw")
def keyword_search(spark, d):
    return _keywords(spark, d, ["Gateway"]).drop("idx")


@query(f"WITH {SAMPLES} SELECT id, 1.0::DOUBLE AS score FROM ck WHERE contains(lower(concat_ws(' ', fn, cls, path)), 'go')")
def like_keyword_short(spark, d):
    return _keywords(spark, d, ["go"]).drop("idx")


@query(f"WITH {SAMPLES}, {CUR}, {_GRAMS}, {_key_sql('vault')}, o AS (SELECT id, round(score, 6) AS score FROM kw ORDER BY round(score, 6) DESC, id LIMIT 500) SELECT id, score FROM o JOIN ck USING (id) WHERE path IN (SELECT file_path FROM cur) ORDER BY score DESC, id LIMIT 50")
def autocomplete(spark, d):
    """Among the paths of the present files, which are many, so ten times the limit is taken first."""
    live = versions(spark, d).select(F.col("file_path").alias("path"))
    return S.autocomplete(_keywords(spark, d, ["vault"]), "id", samples(spark, d).select("id", "path"), live, ["path"], 50)


_TERMS = ["Gateway", "lantern", "Roster"]
_ALL = f"WITH {SAMPLES}, {_GRAMS}, " + ", ".join(_key_sql(w, f"k{i}") for i, w in enumerate([*_TERMS, "qqqzzz"])) + ", al AS (" + " UNION ALL ".join(f"SELECT {i} AS idx, id, round(score, 6) AS score FROM k{i}" for i in range(4)) + ")"


@query(f"{_ALL} SELECT idx, id, score FROM al QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, id) <= 5")
def topk_per_term(spark, d):
    return S.top_per(_keywords(spark, d, _TERMS), ["idx"], 5, "score", "id").drop("_rank")


@query(
    f"{_ALL}, be AS (SELECT idx, id FROM al QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, id) <= 5), "
    "st AS (SELECT (SELECT min(cls) FROM ck) AS c, (SELECT min(fn) FROM ck) AS f), "
    "ex AS (SELECT CASE WHEN cls = c THEN 0 ELSE 1 END AS idx, id, s FROM ck, st WHERE cls = c UNION ALL SELECT 1, id, s FROM ck, st WHERE fn = f), "
    "e2 AS (SELECT idx, id FROM ex QUALIFY row_number() OVER (PARTITION BY idx ORDER BY s NULLS FIRST, id) <= 200), "
    "pk AS (SELECT * FROM e2 UNION ALL SELECT idx, id FROM be WHERE idx NOT IN (SELECT idx FROM e2)) "
    "SELECT idx, id, ck.path || ':' || ck.s || '-' || coalesce(ck.e, ck.s) AS denotation, md5(text) AS digest FROM pk JOIN ck USING (id)"
)
def focussed_snippet_search(spark, d):
    """Several terms at once: the chunks that declare a class or function, for a file or where nothing declares it the five
    best by keyword; with where they lie and their texts. The class and the function asked for are the first of the store."""
    ck = samples(spark, d)
    first = ck.agg(F.min("cls"), F.min("fn")).first()
    terms = spark.createDataFrame([(0, first[0], "class"), (1, first[1], "function"), (2, _TERMS[2], "file")], "query int, keyword string, type string")
    picked = S.focussed_snippets(topk_per_term(spark, d).withColumnRenamed("idx", "query"), ck, terms)
    hit = picked.join(ck, "id")
    return hit.select(F.col("query").alias("idx"), "id", F.concat("path", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.coalesce("e", "s").cast("string")).alias("denotation"), F.md5("text").alias("digest"))


@query(f"{_ALL} SELECT t.idx, t.keyword, count(al.id) AS n_hits FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate([*_TERMS, "qqqzzz"])) + ") t(idx, keyword) LEFT JOIN al USING (idx) GROUP BY ALL")
def outer_terms_results(spark, d):
    """Every search term keeps a row, also without hits."""
    words = [*_TERMS, "qqqzzz"]
    terms = spark.createDataFrame(list(enumerate(words)), "idx int, keyword string")
    return F.broadcast(terms).join(_keywords(spark, d, words), "idx", "left").groupBy("idx", "keyword").agg(F.count("id").alias("n_hits"))


# reranking over the symbols of chunks
_RANGES = "r AS (SELECT DISTINCT ON (id) id, file_id, start_line, end_line FROM chunks WHERE file_id > 0 AND end_line >= start_line AND start_line >= 1)"


def _ranges(spark, d):
    x = read(spark, d, "chunks").where((F.col("file_id") > 0) & (F.col("end_line") >= F.col("start_line")) & (F.col("start_line") >= 1))
    return x.dropDuplicates(["id"]).select("id", "file_id", "start_line", "end_line")


@query(f"WITH {_RANGES} SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.file_id = a.file_id AND b.id <> a.id AND a.start_line >= b.start_line AND a.end_line <= b.end_line)")
def theta_containment_anti(spark, d):
    return S.without_contained(_ranges(spark, d), "file_id", "start_line", "end_line", "id").select("id", "file_id", "start_line", "end_line")


@query(
    f"WITH {_RANGES}, k AS (SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.file_id = a.file_id AND b.id <> a.id AND a.start_line >= b.start_line AND a.end_line <= b.end_line)) "
    "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS pos FROM k"
)
def rerank_heuristic(spark, d):
    """Containment removed, then the order within each file."""
    return S.ranked_heuristic(_ranges(spark, d), "file_id", "start_line", "end_line", "id").select("id", "file_id", "start_line", "end_line", "pos")


# searches in the chunk store: stored chunks stand for chunk files, their paths' present versions for the files to search
_STORE = f"""{SAMPLES}, {CUR}, fh AS (SELECT id AS file_id, max(file_hash) AS file_hash FROM files GROUP BY 1), cf AS (SELECT ck.*, file_hash, fn IS NULL AS import_only FROM ck JOIN fh USING (file_id)),
wl AS (SELECT DISTINCT file_path AS path, file_hash FROM cur WHERE file_hash <> ''), un AS (SELECT chunk_hash, any_value(text) AS text FROM ck GROUP BY 1), {bm25_sql("c", "un", "chunk_hash", "text")},
{_VEC}, cv AS (SELECT chunk_hash, vs.score FROM un JOIN vs ON vs.vec_id = length(un.text) % 500)"""


def _search_sql(name: str, files: str, limit: int, imports: bool) -> str:
    """CTEs of a search: {name} has id, path, s, chunk_hash, score."""
    out = f"""{name}w AS (SELECT cf.* FROM cf WHERE (path, file_hash) IN (SELECT path, file_hash FROM {files})), {name}h AS (SELECT DISTINCT chunk_hash FROM {name}w),
{name}l AS (SELECT k AS chunk_hash, score FROM cbm WHERE k IN (FROM {name}h)), {name}v AS (SELECT * FROM cv WHERE chunk_hash IN (FROM {name}h)),
{name}ln AS (SELECT chunk_hash, (score - lo) / (hi - lo) AS x FROM (SELECT *, CASE WHEN min(score) OVER () < max(score) OVER () THEN min(score) OVER () ELSE 0 END AS lo, max(score) OVER () AS hi FROM {name}l)),
{name}vn AS (SELECT chunk_hash, (score - lo) / (hi - lo) AS x FROM (SELECT *, CASE WHEN min(score) OVER () < max(score) OVER () THEN min(score) OVER () ELSE 0 END AS lo, max(score) OVER () AS hi FROM {name}v)),
{name}f AS (SELECT chunk_hash, 0.7 * coalesce(v.x, 0) + 0.3 * coalesce(l.x, 0) AS score FROM {name}ln l FULL JOIN {name}vn v USING (chunk_hash) ORDER BY score DESC, chunk_hash LIMIT {limit}),
{name}p AS (SELECT w.id, w.path, w.file_hash, w.s, chunk_hash, f.score FROM {name}w w JOIN {name}f f USING (chunk_hash) QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY w.id) = 1)"""
    if not imports:
        return f"{out}, {name} AS (SELECT id, path, s, chunk_hash, score FROM {name}p)"
    return f"""{out}, {name}i AS (SELECT id, path, s, chunk_hash, NULL AS score FROM {name}w WHERE import_only AND (path, file_hash) IN (SELECT path, file_hash FROM {name}p) AND chunk_hash NOT IN (SELECT chunk_hash FROM {name}p)
  QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY id) = 1), {name} AS (SELECT id, path, s, chunk_hash, score FROM {name}p UNION ALL SELECT * FROM {name}i)"""


def _chunk_files(spark, d):
    h = read(spark, d, "files").groupBy(F.col("id").alias("file_id")).agg(F.max("file_hash").alias("file_hash"))
    return samples(spark, d).join(h, "file_id").withColumn("import_only", F.col("fn").isNull())


def _whitelist(spark, d):
    return versions(spark, d).where("file_hash <> ''").select(F.col("file_path").alias("path"), "file_hash").distinct()


def _search(spark, d, files, limit=30, imports=True):
    ck = samples(spark, d)
    lexical = indexes.chunk_texts(spark, d).bm25({0: S.counted_terms(spark, QUERY)}).select(F.col("key").alias("chunk_hash"), "score")
    number = ck.groupBy("chunk_hash").agg((F.first(F.length("text")) % 500).cast("bigint").alias("vec_id"))
    vector = number.join(_vec(spark, d), "vec_id").select("chunk_hash", "score")
    return S.search("vector_db", files=files, chunk_files=_chunk_files(spark, d), lexical=lexical, vector=vector, limit=limit, with_imports=imports)


@query(f"WITH {_QQ}, {_STORE}, {_search_sql('r', 'wl', 30, True)} SELECT id, path, s, round(score, 6) AS score FROM r")
def vectordb_search(spark, d):
    """The thirty best chunks of the present files, each at its first place, with the import-only chunks of their files."""
    return _search(spark, d, _whitelist(spark, d)).select("id", "path", "s", F.round("score", 6).alias("score"))


_DENO = "path || ':' || coalesce(CAST(s AS VARCHAR), '?')"


def _even(query_, names):
    """The injected chooser: keeps denotations of even length."""
    return [n for n in names if n is not None and len(n) % 2 == 0]


def _denoted(x):
    return x.withColumn("denotation", F.concat("path", F.lit(":"), F.coalesce(F.col("s").cast("string"), F.lit("?"))))


@query(f"WITH {_QQ}, {_STORE}, w2 AS (SELECT * FROM wl WHERE starts_with(path, 'src/') OR starts_with(path, 'lib/')), {_search_sql('r', 'w2', 20, False)}, n AS (SELECT *, {_DENO} AS denotation FROM r) SELECT id, denotation FROM n WHERE length(denotation) % 2 = 0 OR (SELECT count(*) FROM n WHERE length(denotation) % 2 = 0) = 0")
def semantic_search(spark, d):
    """Files under the focus directories, hybrid search without imports, then the chooser's choice."""
    files = _whitelist(spark, d).where(F.col("path").startswith("src/") | F.col("path").startswith("lib/"))
    return S.LlmReranker(_even)(_denoted(_search(spark, d, files, 20, False)), "denotation", QUERY).select("id", "denotation")


@query(f"WITH {_QQ}, {_STORE}, {_search_sql('r', 'wl', 30, True)}, n AS (SELECT *, {_DENO} AS denotation FROM r) SELECT id, denotation FROM n WHERE length(denotation) % 2 = 0 OR (SELECT count(*) FROM n WHERE length(denotation) % 2 = 0) = 0")
def rerank_llm(spark, d):
    """An injected chooser keeps some of the denotations it is shown."""
    return S.LlmReranker(_even)(_denoted(vectordb_search(spark, d)), "denotation", QUERY).select("id", "denotation")


@query(
    f"WITH {_QQ}, {_STORE}, ff AS (SELECT DISTINCT path FROM cf JOIN wl USING (path, file_hash) ORDER BY path LIMIT 3), w2 AS (SELECT * FROM wl WHERE path NOT IN (FROM ff) AND NOT starts_with(path, 'web/')), {_search_sql('r', 'w2', 30, True)}, "
    "fo AS (SELECT cf.* FROM cf JOIN ff USING (path)), rx AS (SELECT r.*, cf.e, cf.text FROM r JOIN cf USING (id) WHERE cf.text NOT IN (SELECT text FROM fo)), "
    "al AS (SELECT id, path, s, coalesce(e, s) AS e, 'focus' AS origin FROM fo UNION ALL SELECT id, path, s, coalesce(e, s), 'related' FROM rx) "
    "SELECT id, origin FROM al a WHERE NOT EXISTS (SELECT 1 FROM al b WHERE b.path = a.path AND b.id <> a.id AND a.s >= b.s AND a.e <= b.e) AND a.s IS NOT NULL"
)
def relevant_chunks(spark, d):
    """Chunks of the focus files, and what a search in the other files outside the focus directory finds and they do not
    hold; ranges within others of a file removed."""
    cf, white = _chunk_files(spark, d), _whitelist(spark, d)
    focus_files = cf.join(white, ["path", "file_hash"], "left_semi").select("path").distinct().orderBy("path").limit(3)
    focus = cf.join(F.broadcast(focus_files), "path", "left_semi").select("id", "path", "s", F.coalesce("e", "s").alias("e"), "text")
    others = white.join(F.broadcast(focus_files), "path", "left_anti").where(~F.col("path").startswith("web/"))
    related = _search(spark, d, others).select("id").join(cf, "id").select("id", "path", "s", F.coalesce("e", "s").alias("e"), "text")
    both = checkpoint(S.relevant_chunks(focus, related, "text").select("id", "path", "s", "e", "origin"))  # few rows, used twice
    return S.without_contained(both.where("s is not null"), "path", "s", "e", "id").select("id", "origin")


@query("SELECT * FROM (VALUES ('fused', 'fused search needs lexical, vector'), ('other', 'unknown kind of search: other'), ('vector_db', '')) t(kind, error)")
def search_dispatch(spark, d):
    """Arguments are checked before anything is planned; a search with all of them is planned."""
    rows = []
    for kind, args in (("fused", {"key": "x"}), ("other", {})):
        try:
            S.search(kind, **args)
        except ValueError as e:
            rows.append((kind, str(e)))
    rows.append(("vector_db", "" if set(_search(spark, d, _whitelist(spark, d), 5).columns) >= {"id", "score"} else "no result"))
    return spark.createDataFrame(rows, "kind string, error string")
