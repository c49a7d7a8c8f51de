"""Stand-in tables of the retrieval operators, made from the Parquet tables, each with the SQL that makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.session import read

CUT = "2025-04-01 00:00:00"


def versions(spark, d, until: str | None = None) -> DataFrame:
    """Current version of each file (raw paths), of all rows or of those visible by `until`."""
    f = read(spark, d, "files")
    if until:
        f = f.where(F.col("arrived_at") <= F.lit(until).cast("timestamp"))
    v = f.groupBy("repo_path", "file_path").agg(F.max(F.struct("created_at", "id", "file_hash", "language", "num_lines", "last_used")).alias("m"))
    return v.select("repo_path", "file_path", F.col("m.id").alias("id"), F.col("m.file_hash").alias("file_hash"), F.col("m.language").alias("language"), F.col("m.num_lines").alias("num_lines"), F.col("m.created_at").alias("created_at"))


def samples(spark, d) -> DataFrame:
    """Stored chunks: id, path, text, chunk_hash, s, e, fn, cls, language, created_at; rows written twice once, null contents left out."""
    x = read(spark, d, "sample_data").where(F.col("content").isNotNull()).dropDuplicates(["id"])
    return x.select(
        "id", F.col("file_path").alias("path"), F.col("content").alias("text"), F.md5("content").alias("chunk_hash"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("metadata.function_name").alias("fn"),
        F.col("metadata.class_name").alias("cls"), "language", "created_at", "file_id",
    )


def symbols(spark, d) -> DataFrame:
    """Rows of chunks once each."""
    return read(spark, d, "chunks").dropDuplicates(["id"])


def texts(spark, d) -> DataFrame:
    """Latest sources once each: file_id, repo_path, file_path, file_hash, size_bytes, content (not null)."""
    return read(spark, d, "repo_files").where(F.col("content").isNotNull()).dropDuplicates(["file_id"])


def _versions_sql(name: str, where: str = "") -> str:
    return f"""{name} AS (SELECT repo_path, file_path, m.id AS id, m.file_hash AS file_hash, m.language AS language, m.num_lines AS num_lines, m.created_at AS created_at FROM (
  SELECT repo_path, file_path, arg_max({{'id': id, 'file_hash': file_hash, 'language': language, 'num_lines': num_lines, 'created_at': created_at}}, (created_at, id)) AS m FROM files {where} GROUP BY ALL))"""


CUR = _versions_sql("cur")
OLD = _versions_sql("old", f"WHERE arrived_at <= TIMESTAMPTZ '{CUT}+00'")
SAMPLES = """ck AS (SELECT DISTINCT ON (id) id, file_path AS path, content AS text, md5(content) AS chunk_hash, start_line AS s, end_line AS e, metadata.function_name AS fn, metadata.class_name AS cls, language, created_at, file_id
  FROM sample_data WHERE content IS NOT NULL)"""
SYMBOLS = "sy AS (SELECT DISTINCT ON (id) * FROM chunks)"
TEXTS = "tx AS (SELECT DISTINCT ON (file_id) * FROM repo_files WHERE content IS NOT NULL)"

# identifier tokens of a text column: the look-ahead of the camel pattern is spelled out by two replacements
def tokens_sql(col: str) -> str:
    camel = r"regexp_extract_all(regexp_replace(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]([^A-Za-z ])', '\1', 'g'), '[A-Z][a-z]+|[a-z]+|[A-Z]+')"
    return (
        f"list_transform(list_filter(flatten(list_transform(regexp_extract_all({col}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN contains(w, '_') THEN string_split(w, '_') WHEN len({camel}) > 0 THEN {camel} ELSE [w] END)), "
        "lambda p: length(p) > 1), lambda p: lower(p))"
    )


def runs_sql(lst: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({lst}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({lst}, i, i + {n - 1}), '_'))"


TOKENS = f"""u AS (SELECT doc_id, source, {tokens_sql("text")} AS u FROM documents WHERE text IS NOT NULL),
ub AS (SELECT doc_id, source, list_concat(u, {runs_sql("u", 2)}) AS l, u FROM u),
tk AS (SELECT doc_id, source, list_concat(l, {runs_sql("l", 3)}) AS t, u FROM ub),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL)"""


def query_sql(query: str) -> str:
    q = query.replace("'", "''")
    return f"""q0 AS (SELECT {tokens_sql("'" + q + "'")} AS u), q1 AS (SELECT list_concat(u, {runs_sql("u", 2)}) AS l FROM q0),
qt AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(list_concat(l, {runs_sql("l", 3)})) AS term FROM q1) GROUP BY 1)"""


BM25 = """len AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM documents) AS av),
df AS (SELECT term, count(*) AS df FROM post JOIN qt USING (term) GROUP BY 1),
bm AS (SELECT doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM post JOIN qt USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1)"""


def bm25_sql(p: str, source: str, key: str, text: str) -> str:
    """CTEs that score the texts of a source for the query in qt: {p}bm has k and score."""
    return f"""{p}u AS (SELECT {key} AS k, {tokens_sql(text)} AS u FROM {source} WHERE {text} IS NOT NULL), {p}b AS (SELECT k, list_concat(u, {runs_sql("u", 2)}) AS l FROM {p}u),
{p}p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(list_concat(l, {runs_sql("l", 3)})) AS term FROM {p}b) GROUP BY ALL), {p}l AS (SELECT k, sum(tf) AS dl FROM {p}p GROUP BY 1),
{p}s AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT sum(tf) FROM {p}p) / (SELECT count(*) FROM {source}) AS av), {p}d AS (SELECT term, count(*) AS df FROM {p}p JOIN qt USING (term) GROUP BY 1),
{p}bm AS (SELECT k, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM {p}p JOIN qt USING (term) JOIN {p}d USING (term) JOIN {p}l USING (k), {p}s GROUP BY 1)"""
