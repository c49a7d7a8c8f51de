"""Lexical, vector and hybrid retrieval, keyword search and reranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusmill.functions.text import with_tokens
from corpusmill.operators.prefix import range_parts, with_carry
from corpusmill.operators.textindex import B, K1, TextIndex
from corpusmill.session import spread


def postings(docs: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """key, term, tf: the inverted index. One row per distinct term of a document, counted before any shuffle of the
    text; write it bucketed by term to serve many queries."""
    terms = with_tokens(spread(docs.select(F.col(key).alias(key), F.col(text).alias("_text"))), "_text", "_terms", strict).select(key, F.explode_outer("_terms").alias("term"))
    # an outer explode: for an inner one the optimizer would test the array's size below, building it twice more
    terms = terms.where(F.col("term").isNotNull())
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def collection_stats(post: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """n_docs (all documents, also those without terms) and avgdl: one row."""
    total = post.agg(F.sum("tf").alias("total"))
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(total).select("n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl"))


def query_terms(spark: SparkSession, query: str, strict: bool = False) -> DataFrame:
    """term, qtf of a query; a term that the query repeats counts as often."""
    q = with_tokens(spark.range(1).select(F.lit(query).alias("_text")), "_text", "_terms", strict).select(F.explode("_terms").alias("term"))
    return q.groupBy("term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, key: str, text: str, query: str, strict: bool = False) -> DataFrame:
    """key, score of the documents that have a term of the query; keys are unique.

    Two passes over the texts and no shuffle of them. The first gives the corpus statistics: the number of documents,
    their lengths (the size of a document's token array) and, for the query's terms only, document frequencies - one
    row per term, which is read to the driver together with the query's own terms. The second scores each document in
    its row. A query without terms finds nothing.
    """
    spark = docs.sparkSession
    q = {r[0]: r[1] for r in query_terms(spark, query, strict).collect()}
    if not q:
        return docs.select(key).limit(0).withColumn("score", F.lit(0.0))
    wanted = F.array(*[F.lit(t) for t in sorted(q)])
    cut = with_tokens(spread(docs.select(F.col(key).alias(key), F.col(text).alias("_text"))), "_text", "_terms", strict)
    hits = F.coalesce(F.filter("_terms", lambda t: F.array_contains(wanted, t)), F.array().cast("array<string>"))
    cut = cut.select(key, F.coalesce(F.size("_terms"), F.lit(0)).alias("dl"), hits.alias("hits"))
    # outer explodes: a filter on what they make, or one that the optimizer would add for an inner one, would be pushed
    # down through the columns above and cut up the texts again
    marked = cut.select("dl", F.explode_outer(F.array_append(F.array_distinct("hits"), F.lit(""))).alias("term"))
    rows = marked.groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()
    stats = {r["term"]: (r["n"], r["total"]) for r in rows}
    n, total = stats.pop("", (0, 0))
    if not stats:
        return cut.select(key).limit(0).withColumn("score", F.lit(0.0))
    idf = {t: q[t] * (K1 + 1) * math.log((n - df + 0.5) / (df + 0.5) + 1) for t, (df, _) in stats.items()}
    weight = F.create_map(*[F.lit(x) for kv in sorted(idf.items()) for x in kv])
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(total / n))

    def part(t: Column) -> Column:
        tf = F.size(F.filter("hits", lambda h: h == t))
        return F.element_at(weight, t) * tf / (tf + norm)

    score = F.aggregate(F.array_distinct("hits"), F.lit(0.0), lambda s, t: s + part(t))
    return cut.select(key, F.explode_outer(F.when(F.size("hits") > 0, F.array(score))).alias("score")).where(F.col("score").isNotNull())


def minmax(scored: DataFrame, score: str = "score", out: str = "norm") -> DataFrame:
    """Scores scaled to the range 0..1 of the result; if all are equal they become 1, and no row gives no row."""
    ends = scored.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    lo = F.when(F.col("_lo") < F.col("_hi"), F.col("_lo")).otherwise(F.lit(0.0))
    return scored.crossJoin(F.broadcast(ends)).withColumn(out, (F.col(score) - lo) / F.nullif(F.col("_hi") - lo, F.lit(0.0))).drop("_lo", "_hi")


def counted_terms(spark: SparkSession, query: str, strict: bool = False) -> dict[str, int]:
    """A query's terms and how often it has each."""
    return {r[0]: r[1] for r in query_terms(spark, query, strict).collect()}


def lexical_search(index: TextIndex, title: str, query: str) -> DataFrame:
    """title, score, norm: the best score of each title, scaled over the result; titles come from the index."""
    scored = index.bm25({0: counted_terms(index.spark, query)})
    return minmax(scored.join(index.keys().select("key", title), "key").groupBy(title).agg(F.max("score").alias("score")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(vectors: DataFrame, key: str, vec: str, queries: DataFrame, qvec: str) -> DataFrame:
    """key, score: mean cosine to the query vectors. The query's vectors are one row (an array of vectors) that is
    attached to each row, so nothing multiplies and nothing is shuffled."""
    q = queries.select(F.col(qvec).alias("q")).agg(F.collect_list("q").alias("_qs"))
    one = vectors.select(F.col(key).alias(key), F.col(vec).alias("_v")).crossJoin(F.broadcast(q))
    total = F.aggregate(F.transform("_qs", lambda q: cosine(F.col("_v"), q)), F.lit(0.0), lambda s, x: s + x)
    return one.select(key, (total / F.size("_qs")).alias("score"))


def native_hybrid(chunks: DataFrame, key: str, lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """key, final of every chunk: norm + 3.5 vec for lexical hits, 0.02 vec for others; a missing vec counts 0.04."""
    vec = F.coalesce(F.col("_vec"), F.lit(0.04))
    j = chunks.join(lexical.select(F.col(key), F.col("norm").alias("_lex")), key, "left").join(vector.select(F.col(key), F.col("score").alias("_vec")), key, "left")
    return j.withColumn("final", F.when(F.col("_lex").isNotNull(), F.col("_lex") + 3.5 * vec).otherwise(0.02 * vec)).drop("_lex", "_vec")


def fused(lexical: DataFrame, vector: DataFrame, key: str, alpha: float = 0.7) -> DataFrame:
    """key, score: alpha times the scaled vector score plus the rest times the scaled lexical one; a missing side is 0."""
    a = minmax(lexical.select(key, F.col("score").alias("_l")), "_l", "_ln").select(key, "_ln")
    v = minmax(vector.select(key, F.col("score").alias("_v")), "_v", "_vn").select(key, "_vn")
    return a.join(v, key, "full_outer").select(key, (alpha * F.coalesce("_vn", F.lit(0.0)) + (1 - alpha) * F.coalesce("_ln", F.lit(0.0))).alias("score"))


def top(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k greatest by score, ties by the given columns: one TakeOrderedAndProject, no global sort."""
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def top_per(df: DataFrame, group: list[str], k: int, score: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def trigrams(text: Column) -> Column:
    """Lower-cased runs of three characters of each word; words shorter than three stay whole."""
    ws = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.flatten(F.transform(ws, cut))


def keyword_search(rows: DataFrame, key: str, fields: list[str], index: TextIndex, keywords: list[str], limit: int | None = None) -> DataFrame:
    """query (number of the keyword), key, score. Keywords under three characters match as substrings of a field (score 1);
    others are scored by BM25 over the character trigrams of all fields together, all keywords in one scan of the index."""
    spark = rows.sparkSession
    grams = {i: w for i, w in enumerate(keywords) if len(w) >= 3}
    out = None
    if grams:
        cut = spark.createDataFrame(list(grams.items()), "query int, word string").select("query", F.explode(trigrams(F.col("word"))).alias("term")).groupBy("query", "term").count().collect()
        out = index.bm25({i: {r["term"]: r["count"] for r in cut if r["query"] == i} for i in grams}).withColumnRenamed("key", key)
    both = F.lower(F.concat_ws(" ", *[F.col(f) for f in fields]))
    for i, w in enumerate(keywords):
        if i not in grams:
            hit = rows.where(both.contains(w.lower())).select(F.lit(i).alias("query"), key, F.lit(1.0).alias("score"))
            out = hit if out is None else out.unionByName(hit)
    return out if limit is None else top_per(out, ["query"], limit, "score", key).drop("_rank")


def exact_symbols(chunk_files: DataFrame, terms: DataFrame, limit: int = 200) -> DataFrame:
    """query, id, s of the chunks that declare a term (query, keyword, type 'class' or 'function'), at most `limit` of each in
    the order of their lines. Terms are a query's own, so few."""
    hit = chunk_files.join(F.broadcast(terms), ((F.col("type") == "class") & (F.col("cls") == F.col("keyword"))) | ((F.col("type") == "function") & (F.col("fn") == F.col("keyword"))))
    w = Window.partitionBy("query").orderBy(F.asc_nulls_first("s"), "id")
    return hit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("query", "id", "s")


def focussed_snippets(hits: DataFrame, chunk_files: DataFrame, terms: DataFrame) -> DataFrame:
    """query, id: of each term the chunks that declare it, where there are any, else its hits by keyword."""
    exact = exact_symbols(chunk_files, terms).select("query", "id")
    rest = hits.join(F.broadcast(exact.select("query").distinct()), "query", "left_anti").select("query", "id")
    return exact.unionByName(rest)


def autocomplete(scored: DataFrame, key: str, rows: DataFrame, allowed: DataFrame, on: list[str], limit: int, pre_filter_limit: int = 100) -> DataFrame:
    """key, score of the best hits whose row is allowed. With few allowed rows they are picked before the limit; with
    `pre_filter_limit` or more, ten times the limit is taken first and picked from afterwards."""
    few = allowed.select(*on).distinct().limit(pre_filter_limit).count() < pre_filter_limit
    placed = lambda x: x.join(rows.select(key, *on), key).join(allowed.select(*on).distinct(), on, "left_semi").select(key, "score")
    return top(placed(scored) if few else placed(top(scored, 10 * limit, "score", key)), limit, "score", key)


def vectordb_search(files: DataFrame, chunk_files: DataFrame, lexical: DataFrame, vector: DataFrame, limit: int, with_imports: bool = True) -> DataFrame:
    """id, path, s, chunk_hash, score: hybrid search in the chunks of some files.

    files: path, file_hash; chunk_files: id, path, file_hash, chunk_hash, s, import_only; lexical and vector: chunk_hash,
    score. The chunks of the files are ranked by fused scores; each of the best `limit` goes to its first place (least id)
    in these files; the import-only chunks of the files that hits lie in are added; a content counts once. Ordered by path
    and line. Only hits, at most `limit` rows, are broadcast.
    """
    white = chunk_files.join(files.select("path", "file_hash").distinct(), ["path", "file_hash"], "left_semi")
    known = white.select("chunk_hash").distinct()
    only = lambda x: x.join(known, "chunk_hash", "left_semi")
    hits = top(fused(only(lexical), only(vector), "chunk_hash"), limit, "score", "chunk_hash")
    first = lambda x: x.groupBy("chunk_hash").agg(F.min(F.struct("id", "path", "file_hash", "s", "score")).alias("m")).select("chunk_hash", "m.*")
    placed = first(white.join(F.broadcast(hits), "chunk_hash"))
    if with_imports:
        near = white.where("import_only").join(F.broadcast(placed.select("path", "file_hash").distinct()), ["path", "file_hash"], "left_semi")
        added = first(near.withColumn("score", F.lit(None).cast("double"))).join(F.broadcast(placed.select("chunk_hash")), "chunk_hash", "left_anti")
        placed = placed.unionByName(added)
    return placed.select("id", "path", "s", "chunk_hash", "score").orderBy("path", "s")


def relevant_chunks(focus: DataFrame, related: DataFrame, text: str, rerank=None) -> DataFrame:
    """Focus chunks and related ones whose text is no focus chunk's, the related ones through a reranker if one is given."""
    rest = related.join(focus.select(text).distinct(), text, "left_anti").select(*related.columns)
    rest = rerank(rest) if rerank else rest
    return focus.withColumn("origin", F.lit("focus")).unionByName(rest.withColumn("origin", F.lit("related")))


def without_contained(chunks: DataFrame, path: str, start: str, end: str, key: str, keep_one: bool = False) -> DataFrame:
    """Drop a chunk whose range lies within another's of the same file. Equal ranges drop each other, as rerankers in
    use do, unless `keep_one`, which keeps the one with the least key.

    No self join: a range is contained if an earlier start reaches its end, or one with the same start does; both are
    running maxima over ranges ordered by (start, end desc), after equal ranges were counted. The maxima run within range
    parts and are carried over them, so a file with very many ranges is no single task's work.
    """
    same = chunks.groupBy(path, start, end).agg(F.count("*").alias("_same"), F.min(key).alias("_first")).withColumn("_down", -F.col(end))
    p = with_carry(range_parts(same, [path, start, "_down"]), [path], F.max(end), F.max)
    w = Window.partitionBy(path, "_part").orderBy(start, "_down").rowsBetween(Window.unboundedPreceding, -1)
    free = p.withColumn("_reach", F.greatest(F.max(end).over(w), F.col("_carry"))).where(F.col("_reach").isNull() | (F.col("_reach") < F.col(end)))
    free = free if keep_one else free.where(F.col("_same") == 1)
    out = chunks.join(free.select(path, start, end, "_first"), [path, start, end])
    return (out.where(F.col(key) == F.col("_first")) if keep_one else out).drop("_first")


def ranked_heuristic(chunks: DataFrame, path: str, start: str, end: str, key: str) -> DataFrame:
    """Chunks without those contained in others, and `pos`, their place in their file by (start, key)."""
    free = without_contained(chunks, path, start, end, key)
    p = with_carry(range_parts(free, [path, start, key]), [path], F.count("*"), F.sum)
    w = Window.partitionBy(path, "_part").orderBy(start, key)
    return p.withColumn("pos", F.row_number().over(w) + F.coalesce("_carry", F.lit(0))).drop("_part", "_carry")


class LlmReranker:
    """Keeps the chunks whose denotations an injected callable returns, in their own order; an empty answer keeps all.

    More different denotations than `most` are refused, as the chooser could not see them all.
    """

    def __init__(self, choose, most: int = 1000):
        self.choose, self.most = choose, most

    def __call__(self, chunks: DataFrame, denotation: str, query: str) -> DataFrame:
        shown = sorted((r[0] for r in chunks.select(denotation).distinct().limit(self.most + 1).collect()), key=lambda x: (x is None, x))
        if len(shown) > self.most:
            raise ValueError(f"more than {self.most} denotations to choose from: rank and cut them before")
        names = list(self.choose(query, shown))
        return chunks.where(F.col(denotation).isin(names)) if names else chunks


def search(kind: str, **args) -> DataFrame:
    """Dispatch by kind ('native', 'vector_db', 'fused') after a check of the arguments it needs."""
    kinds = {
        "native": ({"chunks", "key", "lexical", "vector"}, native_hybrid), "vector_db": ({"files", "chunk_files", "lexical", "vector", "limit"}, vectordb_search), "fused": ({"lexical", "vector", "key"}, fused),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind of search: {kind}")
    names, fn = kinds[kind]
    if missing := {n for n in names if args.get(n) is None}:
        raise ValueError(f"{kind} search needs {', '.join(sorted(missing))}")
    return fn(**args)
