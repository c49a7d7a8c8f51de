"""Queries of scans, the chunk store, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusmill.functions import lang as L, text as T
from corpusmill.functions.paths import base_name
from corpusmill.operators import store as S
from corpusmill.session import read, scratch

from .tables import CUR, CUT, OLD, SAMPLES, SYMBOLS, TEXTS, samples, symbols, texts, versions

QUERIES, ORACLE = {}, {}
SKIP_DIRS = ["node_modules", "vendor", "third_party", "build", "dist", "Pods"]
SKIP_EXTS = [".rb", ".kt"]
#: Lines that one read of a range gives.
MOST_LINES = 1000


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _ts(text: str):
    return F.lit(text).cast("timestamp")


# scans
_SKIP = "|".join(SKIP_DIRS)


@query(f"WITH {TEXTS} SELECT file_id, file_path FROM tx WHERE NOT regexp_matches(file_path, '(^|/)({_SKIP})/') AND NOT regexp_matches(file_path, '\\.(rb|kt)$')")
def scan_glob_args(spark, d):
    return L.outside_globs(texts(spark, d), "file_path", SKIP_DIRS, SKIP_EXTS).select("file_id", "file_path")


@query(f"WITH {TEXTS} SELECT file_id, md5(content) AS digest FROM tx WHERE repo_path IN (SELECT repo_path FROM files GROUP BY 1 HAVING count(*) > 10)")
def scan_files_with_hash(spark, d):
    allow = read(spark, d, "files").groupBy("repo_path").agg(F.count("*").alias("n")).where("n > 10")
    return texts(spark, d).join(allow, "repo_path", "left_semi").select("file_id", F.md5("content").alias("digest"))


@query(f"WITH {TEXTS} SELECT tx.file_id, tx.file_path FROM tx WHERE (repo_path, file_path) IN (SELECT repo_path, replace(file_path, '\\', '/') FROM files)")
def scan_files_from_list(spark, d):
    wanted = read(spark, d, "files").select("repo_path", F.translate("file_path", "\\", "/").alias("file_path")).distinct()
    return texts(spark, d).join(wanted, ["repo_path", "file_path"], "left_semi").select("file_id", "file_path")


@query(f"WITH {CUR} SELECT repo_path, file_path, trim(file_hash) AS file_hash FROM cur WHERE trim(file_hash) <> '' AND file_path <> ''")
def scan_git_snapshot(spark, d):
    """Lines as a tree listing prints them, parsed back."""
    raw = versions(spark, d).where((F.trim("file_hash") != "") & (F.col("file_path") != ""))
    raw = raw.select("repo_path", F.concat(F.lit("100644 blob "), F.trim("file_hash"), F.lit("\t"), "file_path").alias("line"))
    return L.parse_tree_listing(raw, "line").select("repo_path", "file_path", "file_hash")


_DIRTY = "CASE id % 4 WHEN 0 THEN ' M ' || file_path WHEN 1 THEN '?? ' || file_path WHEN 2 THEN 'R  ' || file_path || ' -> moved/' || file_path ELSE ' D ' || file_path END"


def _dirty(spark, d):
    p = F.col("file_path")
    k = F.col("id") % 4
    line = F.when(k == 0, F.concat(F.lit(" M "), p)).when(k == 1, F.concat(F.lit("?? "), p)).when(k == 2, F.concat(F.lit("R  "), p, F.lit(" -> moved/"), p)).otherwise(F.concat(F.lit(" D "), p))
    return versions(spark, d, CUT).select("repo_path", line.alias("line"))


@query(f"WITH {OLD}, s AS (SELECT repo_path, {_DIRTY} AS line FROM old) SELECT repo_path, trim(substr(line, 1, 2)) AS status, CASE WHEN contains(line, ' -> ') THEN split_part(line, ' -> ', 2) ELSE substr(line, 4) END AS file_path FROM s")
def scan_git_dirty(spark, d):
    return L.parse_status(_dirty(spark, d), "line").select("repo_path", "status", "file_path")


@query(
    f"WITH {CUR}, {OLD}, dirty AS (SELECT repo_path, file_path, file_hash FROM cur WHERE created_at > TIMESTAMPTZ '{CUT}+00') SELECT repo_path, file_path, file_hash FROM old WHERE (repo_path, file_path) NOT IN (SELECT repo_path, file_path FROM dirty) "
    "UNION ALL SELECT repo_path, file_path, file_hash FROM dirty"
)
def scan_git_overlay(spark, d):
    """A snapshot overlaid by the files changed since."""
    dirty = versions(spark, d).where(F.col("created_at") > _ts(CUT)).select("repo_path", "file_path", "file_hash")
    return S.upsert(versions(spark, d, CUT).select("repo_path", "file_path", "file_hash"), dirty, ["repo_path", "file_path"])


@query(f"WITH {TEXTS} SELECT DISTINCT repo_path, split_part(file_path, '/', 1) AS name, CASE WHEN contains(file_path, '/') THEN 'dir' ELSE 'file' END AS kind FROM tx")
def scan_directory_listing(spark, d):
    return L.listing(texts(spark, d), "repo_path", "file_path")


@query(f"WITH {SAMPLES}, {CUR} SELECT id, path FROM ck WHERE path IN (SELECT file_path FROM cur WHERE file_hash IS NOT NULL)")
def scan_collection(spark, d):
    live = versions(spark, d).where(F.col("file_hash").isNotNull()).select(F.col("file_path").alias("path")).distinct()
    return samples(spark, d).join(live, "path", "left_semi").select("id", "path")


@query(f"WITH {SAMPLES} SELECT id, chunk_hash, length(text) AS n_chars FROM ck WHERE chunk_hash IN (SELECT chunk_hash FROM ck GROUP BY 1 HAVING count(*) > 1)")
def lookup_chunks_by_hash(spark, d):
    ck = samples(spark, d)
    many = ck.groupBy("chunk_hash").agg(F.count("*").alias("n")).where("n > 1")
    return ck.join(many, "chunk_hash", "left_semi").select("id", "chunk_hash", F.length("text").alias("n_chars"))


@query("SELECT repo_path, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM files GROUP BY 1")
def scan_sqlite_files(spark, d):
    return read(spark, d, "files").groupBy("repo_path").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@query("SELECT id, file_path FROM files WHERE repo_path = (SELECT max(repo_path) FROM files)")
def scan_sqlite_files_by_repo(spark, d):
    f = read(spark, d, "files")
    return f.join(F.broadcast(f.agg(F.max("repo_path").alias("repo_path"))), "repo_path", "left_semi").select("id", "file_path")


@query(f"WITH {SYMBOLS} SELECT id, node_name FROM sy WHERE file_id = (SELECT min(file_id) FROM sy WHERE file_id > 0)")
def scan_chunks_for_file(spark, d):
    sy = symbols(spark, d)
    one = sy.where("file_id > 0").agg(F.min("file_id").alias("file_id"))
    return sy.join(F.broadcast(one), "file_id", "left_semi").select("id", "node_name")


@query(f"WITH {TEXTS} SELECT file_id, md5(content) AS digest FROM tx")
def read_file_lossy(spark, d):
    raw = texts(spark, d).select("file_id", F.encode("content", "utf-8").alias("raw"))
    return raw.select("file_id", F.md5(L.lossy_utf8(F.col("raw"))).alias("digest"))


@query(f"WITH {TEXTS} SELECT file_id, md5(array_to_string(list_slice(string_split(content, chr(10)), 5, 1004), chr(10))) AS digest, len(string_split(content, chr(10))) <= 1004 AS eof FROM tx")
def read_line_range(spark, d):
    """Lines five to two thousand, of which a read gives a thousand, and whether the end was reached."""
    c, last = F.col("content"), min(2000, 5 + MOST_LINES - 1)
    return texts(spark, d).select("file_id", F.md5(T.line_range(c, F.lit(5), F.lit(last))).alias("digest"), (F.size(T.lines(c)) <= last).alias("eof"))


@query(f"WITH {TEXTS} SELECT file_id, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CAST(ends_with(content, chr(10)) AS INT) END AS n_lines FROM tx")
def count_lines(spark, d):
    return texts(spark, d).select("file_id", T.count_lines(F.col("content")).alias("n_lines"))


@query(f"WITH {SAMPLES}, {TEXTS} SELECT ck.id, md5(array_to_string(list_slice(string_split(content, chr(10)), s, e), chr(10))) AS digest FROM ck JOIN tx USING (file_id) WHERE s >= 1 AND e >= s")
def read_file_slice(spark, d):
    j = samples(spark, d).where((F.col("s") >= 1) & (F.col("e") >= F.col("s"))).join(texts(spark, d).select("file_id", "content"), "file_id")
    return j.select("id", F.md5(T.line_range(F.col("content"), F.col("s"), F.col("e"))).alias("digest"))


@query()
def scan_repo_files(spark, d):
    """Files under the folder of the tables themselves, with their sizes."""
    from corpusmill.sources.tree import scan_tree

    return scan_tree(spark, d, with_content=False).select(base_name(F.col("path")).alias("name"), "length")


@query()
def object_store_get(spark, d):
    """Objects put under a folder, read back, and one of them deleted: how many are there before and after."""
    from corpusmill.sources.tree import delete_object, get_object

    folder = scratch(spark)
    try:
        read(spark, d, "files").write.parquet(f"{folder}/objects")
        objects = get_object(spark, f"{folder}/objects").where(F.col("path").endswith(".parquet")).select("path", "length").orderBy("path")
        n, first = objects.count(), objects.first()[0]
        gone = delete_object(spark, first)
        left = get_object(spark, f"{folder}/objects").where(F.col("path").endswith(".parquet")).count() if n > 1 else 0
    finally:
        S.drop_all(spark, folder)
    return spark.createDataFrame([(n, gone, left)], "n_objects bigint, deleted boolean, n_left bigint")


@query()
def create_collections(spark, d):
    """Collections of the store made where they are not there yet: all at first, none the second time."""
    folder, rows = scratch(spark), []
    try:
        for step in (1, 2):
            for name, schema in S.COLLECTIONS.items():
                rows.append((step, name, S.create_collection(spark, folder, name, schema)))
    finally:
        S.drop_all(spark, folder)
    return spark.createDataFrame(rows, "step int, name string, created boolean")


@query()
def embed_service(spark, d):
    """Documents through the deterministic hashing embedder."""
    from corpusmill.operators.embed import embed

    return embed(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("vector").alias("dims"))


# store
@query(f"WITH {SAMPLES}, o AS (SELECT * FROM ck WHERE created_at < TIMESTAMPTZ '{CUT}+00'), n AS (SELECT * FROM ck WHERE created_at >= TIMESTAMPTZ '{CUT}+00') SELECT chunk_hash, max(w) AS origin FROM (SELECT chunk_hash, 'old' AS w FROM o WHERE chunk_hash NOT IN (SELECT chunk_hash FROM n) UNION ALL SELECT chunk_hash, 'new' FROM n) GROUP BY 1")
def upsert_chunks(spark, d):
    ck = samples(spark, d)
    old = ck.where(F.col("created_at") < _ts(CUT)).select("chunk_hash").distinct().withColumn("origin", F.lit("old"))
    new = ck.where(F.col("created_at") >= _ts(CUT)).select("chunk_hash").distinct().withColumn("origin", F.lit("new"))
    return S.upsert(old, new, ["chunk_hash"])


_UUID = "lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST(((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4) AS INT) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)))"


@query(f"WITH {SAMPLES}, k AS (SELECT id, created_at, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(path || chunk_hash || s || '-' || coalesce(e, s))) AS h FROM ck) SELECT {_UUID} AS key, count(*) AS n, epoch_us(max(created_at)) AS created_at FROM k GROUP BY 1")
def upsert_chunk_files(spark, d):
    """Keyed by path, hash and lines; of rows with one key the latest stays."""
    k = F.concat("path", "chunk_hash", F.col("s").cast("string"), F.lit("-"), F.coalesce("e", "s").cast("string"))
    return samples(spark, d).select(T.uuid5(k).alias("key"), "created_at").groupBy("key").agg(F.count("*").alias("n"), F.unix_micros(F.max("created_at")).alias("created_at"))


@query(f"WITH {SAMPLES} SELECT id, chunk_hash, count(*) OVER (PARTITION BY path) AS total_chunks, regexp_extract(path, '[^/]*$') AS searchable_file_name, coalesce(cls, '') AS classes, coalesce(fn, '') AS functions, fn IS NULL AND cls IS NULL AS has_imports FROM ck WHERE path IS NOT NULL")
def store_differential(spark, d):
    """Chunk file rows of stored chunks: the number of chunks of the file, its name, classes, functions, imports."""
    ck = samples(spark, d).where("path is not null")
    total = ck.groupBy("path").agg(F.count("*").alias("total_chunks"))
    names = lambda c: F.array_join(F.filter(F.array(c), lambda x: x.isNotNull()), ",")
    return ck.join(total, "path").select("id", "chunk_hash", "total_chunks", base_name(F.col("path")).alias("searchable_file_name"), names("cls").alias("classes"), names("fn").alias("functions"), (F.col("fn").isNull() & F.col("cls").isNull()).alias("has_imports"))


_LIVE = "live AS (SELECT DISTINCT file_path AS path FROM cur WHERE file_hash <> '')"


def _live(spark, d):
    return versions(spark, d).where("file_hash <> ''").select(F.col("file_path").alias("path")).distinct()


@query(f"WITH {SAMPLES}, {CUR}, {_LIVE} SELECT id, epoch_us(CASE WHEN path IN (FROM live) THEN TIMESTAMPTZ '2025-05-10 00:00:00+00' ELSE created_at END) AS created_at FROM ck WHERE path IS NOT NULL")
def refresh_timestamps(spark, d):
    ck = samples(spark, d).where(F.col("path").isNotNull()).select("id", "path", "created_at")
    return S.refresh(ck, _live(spark, d), "path", _ts("2025-05-10 00:00:00"), ["created_at"]).select("id", F.unix_micros("created_at").alias("created_at"))


@query(f"WITH {SAMPLES}, u AS (SELECT chunk_hash, any_value(length(text)) % 700 AS n FROM ck GROUP BY 1) SELECT chunk_hash, CASE WHEN v.vec_id IS NULL THEN 0 ELSE len(embedding) END AS dims, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS first FROM u LEFT JOIN embeddings v ON v.vec_id = n")
def update_embedding(spark, d):
    """Vectors set by the chunk's hash; a chunk for which none came keeps what it had, here nothing."""
    u = samples(spark, d).groupBy("chunk_hash").agg((F.first(F.length("text")) % 700).cast("bigint").alias("vec_id"))
    v = u.join(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "left").withColumn("vector", F.coalesce("embedding", F.array().cast("array<float>")))
    return v.select("chunk_hash", F.size("vector").alias("dims"), F.round(F.coalesce(F.get("vector", 0).cast("double"), F.lit(0.0)), 6).alias("first"))


@query(f"WITH {SAMPLES}, {CUR}, {_LIVE} SELECT id FROM ck WHERE NOT coalesce(created_at < TIMESTAMPTZ '2025-04-15 00:00:00+00', false) OR path IN (FROM live)")
def ttl_cleanup(spark, d):
    ck = samples(spark, d).select("id", "path", "created_at")
    return S.expire(ck, _live(spark, d), "path", "created_at", _ts("2025-04-15 00:00:00")).select("id")


@query("SELECT row_number() OVER (ORDER BY file_path, repo_path, id, arrived_at) AS new_id, file_path, repo_path FROM (SELECT DISTINCT repo_path, file_path, id, arrived_at FROM files)")
def sqlite_insert_file(spark, d):
    f = read(spark, d, "files").select("repo_path", "file_path", "id", "arrived_at").distinct()
    return S.numbered(f, ["file_path", "repo_path", "id", "arrived_at"], "new_id").select("new_id", "file_path", "repo_path")


_GONE = "gone AS (SELECT file_id AS id FROM file_deletions GROUP BY 1 HAVING arg_max(restored_at IS NULL, deleted_at))"


@query(f"WITH {_GONE}, {SYMBOLS} SELECT 'files' AS tbl, count(DISTINCT id) AS n FROM files WHERE id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM sy WHERE file_id IS NULL OR file_id NOT IN (FROM gone)")
def sqlite_delete_cascade(spark, d):
    from corpusmill.operators.orphans import deletion_state

    gone = deletion_state(read(spark, d, "file_deletions")).withColumnRenamed("file_id", "id")
    f, c = S.cascade_delete(read(spark, d, "files").select("id").distinct(), symbols(spark, d), gone, "file_id")
    one = lambda x, n: x.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
    return one(f, "files").unionByName(one(c, "chunks"))


@query(f"WITH {CUR} SELECT id, CASE WHEN language IS NULL THEN 'changed' ELSE file_hash END AS file_hash FROM cur")
def sqlite_update_hash(spark, d):
    return versions(spark, d).select("id", F.when(F.col("language").isNull(), "changed").otherwise(F.col("file_hash")).alias("file_hash"))


@query()
def sqlite_snapshot(spark, d):
    """Write files and chunks as versioned snapshots, read them back, then drop them."""
    rows, folder = [], scratch(spark)
    try:
        for tbl in ("files", "chunks"):
            at = f"{folder}/{tbl}"
            S.ensure_schema(spark, at, 19, lambda: read(spark, d, tbl))
            again = S.ensure_schema(spark, at, 19, lambda: read(spark, d, tbl))
            n = spark.read.parquet(f"{at}/schema=19/data").count()
            S.drop_all(spark, at)
            rows.append((tbl, n, again, S.schema_version(spark, at)))
    finally:
        S.drop_all(spark, folder)
    return spark.createDataFrame(rows, "tbl string, n_rows bigint, recreated boolean, version_after int")


# filters
@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE NOT regexp_matches(file_path, '\\.(rb|kt)$') AND size_bytes <= 8388608 AND NOT regexp_matches(file_path, '(^|/)({_SKIP})/')")
def is_file_chunkable(spark, d):
    return texts(spark, d).where(L.chunkable(F.col("file_path"), F.col("size_bytes"), SKIP_DIRS, SKIP_EXTS)).select("file_id")


@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE regexp_matches(file_path, '(^|/)({'|'.join(x.replace('.', '[.]') for x in L.IGNORED_PARTS)})(/|$)') OR regexp_matches(lower(file_path), '[^/](\\.({'|'.join(x[1:] for x in L.BINARY_SUFFIXES)}))$')")
def should_ignore_file(spark, d):
    return texts(spark, d).where(L.ignored(F.col("file_path"))).select("file_id")


@query(f"WITH {TEXTS}, {CUR} SELECT tx.file_id FROM tx WHERE (file_path, file_hash) IN (SELECT file_path, file_hash FROM cur)")
def whitelist_pairs(spark, d):
    pairs = versions(spark, d).select("file_path", "file_hash").distinct()
    return texts(spark, d).join(pairs, ["file_path", "file_hash"], "left_semi").select("file_id")


@query(f"WITH {SYMBOLS} SELECT DISTINCT file_id FROM sy WHERE category = 'import' AND file_id IN (SELECT id FROM files)")
def has_imports_filter(spark, d):
    f = read(spark, d, "files").select(F.col("id").alias("file_id")).distinct()
    return symbols(spark, d).where("category = 'import'").select("file_id").distinct().join(f, "file_id", "left_semi")


@query(f"WITH {SAMPLES} SELECT id FROM ck WHERE chunk_hash IN (SELECT md5(content) FROM repo_files)")
def hash_in_set(spark, d):
    h = read(spark, d, "repo_files").select(F.md5("content").alias("chunk_hash")).distinct()
    return samples(spark, d).join(h, "chunk_hash", "left_semi").select("id")


@query(f"WITH {SYMBOLS}, top AS (SELECT node_name FROM sy WHERE category = 'function' GROUP BY 1 ORDER BY count(*) DESC, node_name LIMIT 1) SELECT id, start_line FROM sy WHERE category = 'function' AND node_name IN (FROM top) ORDER BY start_line NULLS FIRST, id LIMIT 200")
def exact_symbol(spark, d):
    sy = symbols(spark, d).where("category = 'function'")
    one = sy.groupBy("node_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_name").limit(1)
    return sy.join(F.broadcast(one), "node_name", "left_semi").select("id", "start_line").orderBy(F.asc_nulls_first("start_line"), "id").limit(200)


@query("SELECT * FROM (VALUES ('class', 'classes'), ('function', 'functions'), ('file', 'searchable_file_path'), ('file', 'searchable_file_name')) t(kind, property)")
def type_property_map(spark, d):
    return spark.createDataFrame([(k, p) for k, ps in L.PROPERTIES.items() for p in ps], "kind string, property string")


@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE starts_with(file_path, 'src/') OR starts_with(file_path, 'lib/')")
def focus_directory_prefix(spark, d):
    return texts(spark, d).where(L.under(F.col("file_path"), ["src/", "lib/"])).select("file_id")


@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE file_path NOT IN (SELECT file_path FROM sample_data WHERE file_path IS NOT NULL)")
def exclude_focus_files(spark, d):
    focus = read(spark, d, "sample_data").where("file_path is not null").select("file_path").distinct()
    return texts(spark, d).join(focus, "file_path", "left_anti").select("file_id")


@query(f"WITH {SAMPLES} SELECT id FROM ck WHERE language IS DISTINCT FROM 'python' AND chunk_hash NOT IN (SELECT chunk_hash FROM ck WHERE language = 'python')")
def exclude_focused_chunks(spark, d):
    ck = samples(spark, d)
    focus = ck.where("language = 'python'").select("chunk_hash").distinct()
    return ck.where("language is distinct from 'python'").join(focus, "chunk_hash", "left_anti").select("id")


@query(f"WITH {SAMPLES}, n AS (SELECT id, language, path || ':' || s || '-' || e AS name FROM ck) SELECT id, row_number() OVER (ORDER BY id) AS ord FROM n WHERE name IN (SELECT name FROM n WHERE language = 'python' AND name IS NOT NULL)")
def filter_by_denotation(spark, d):
    """Chunks whose denotation was chosen, in their original order."""
    ck = samples(spark, d).select("id", "language", L.denotation("path", "s", "e").alias("name"))
    chosen = ck.where("language = 'python' and name is not null").select("name").distinct()
    return S.numbered(ck.join(chosen, "name", "left_semi").select("id"), ["id"], "ord")


@query("WITH p AS (SELECT max(file_path) AS f FROM files) SELECT DISTINCT id FROM files, p WHERE file_path = f")
def refilter_by_path(spark, d):
    f = read(spark, d, "files")
    return f.join(F.broadcast(f.agg(F.max("file_path").alias("file_path"))), "file_path", "left_semi").select("id").distinct()


@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE regexp_matches(file_path, '(^|/)[^/]*gen[^/]*/') OR regexp_matches(file_path, '(^|/)\\.[^/]*/')")
def prune_dirs(spark, d):
    return texts(spark, d).where(L.pruned(F.col("file_path"), set(), ["*gen*"])).select("file_id")


@query(f"WITH {SAMPLES}, {CUR}, {_LIVE}, o AS (SELECT id, path FROM ck ORDER BY id LIMIT 500) SELECT id FROM o WHERE path IN (FROM live) ORDER BY id LIMIT 50")
def post_filter_paths(spark, d):
    """Limit times ten first, filter afterwards, then the limit: a stated mode of the autocompletion."""
    over = samples(spark, d).select("id", "path").orderBy("id").limit(500)
    return over.join(_live(spark, d), "path", "left_semi").select("id").orderBy("id").limit(50)


@query(f"WITH {SYMBOLS} SELECT id, CASE WHEN start_line >= 1 THEN start_line END AS start_line FROM sy")
def keep_positive(spark, d):
    return symbols(spark, d).select("id", F.when(F.col("start_line") >= 1, F.col("start_line")).alias("start_line"))


@query("SELECT run_id FROM (SELECT run_id, arg_max(lower(trim(status)), logged_at) AS st FROM index_runs GROUP BY 1) WHERE st = 'succeeded' AND run_id % 5 <> 0")
def server_status_filter(spark, d):
    """Connected and not disabled: runs that succeeded stand for connected servers, every fifth is disabled."""
    st = read(spark, d, "index_runs").groupBy("run_id").agg(F.max(F.struct("logged_at", F.lower(F.trim("status")).alias("s"))).alias("m"))
    return st.where("m.s = 'succeeded' and run_id % 5 <> 0").select("run_id")


# joins
@query(f"WITH {SAMPLES}, u AS (SELECT chunk_hash, any_value(length(text)) AS n FROM ck GROUP BY 1) SELECT path, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_chars FROM ck JOIN u USING (chunk_hash) GROUP BY 1")
def join_store_reload(spark, d):
    ck = samples(spark, d)
    u = ck.groupBy("chunk_hash").agg(F.max(F.length("text")).alias("n"))
    return ck.select("path", "chunk_hash").join(u, "chunk_hash").groupBy("path").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_chars"))


@query(f"WITH {SAMPLES}, f AS (SELECT chunk_hash, min(id) AS first_id FROM ck GROUP BY 1) SELECT DISTINCT rf.file_id, first_id FROM repo_files rf JOIN f ON f.chunk_hash = md5(rf.content)")
def join_search_meta(spark, d):
    """Each hit with the first stored chunk of its hash."""
    first = samples(spark, d).groupBy("chunk_hash").agg(F.min("id").alias("first_id"))
    return read(spark, d, "repo_files").select("file_id", F.md5("content").alias("chunk_hash")).join(first, "chunk_hash").select("file_id", "first_id").distinct()


@query(f"WITH {SYMBOLS}, hit AS (SELECT DISTINCT file_id FROM sy WHERE category = 'class' AND file_id > 0) SELECT sy.id FROM sy JOIN hit USING (file_id) WHERE category IN ('class', 'import')")
def join_import_augment(spark, d):
    """Hits, and the import symbols of the hits' files."""
    sy = symbols(spark, d)
    hit = sy.where("category = 'class' and file_id > 0").select("file_id").distinct()
    return sy.where("category in ('class', 'import')").join(hit, "file_id", "left_semi").select("id")


@query(f"WITH {SYMBOLS}, f AS (SELECT id, min(file_path) AS file_path FROM files GROUP BY 1) SELECT sy.id, file_path, start_line FROM sy JOIN f ON f.id = sy.file_id")
def join_symbols_files(spark, d):
    f = read(spark, d, "files").groupBy(F.col("id").alias("file_id")).agg(F.min("file_path").alias("file_path"))
    return symbols(spark, d).join(f, "file_id").select("id", "file_path", "start_line").orderBy("file_path", "start_line")


_DIFF = f"""WITH {CUR}, {OLD} SELECT coalesce(cur.repo_path, old.repo_path) AS repo_path, coalesce(cur.file_path, old.file_path) AS file_path,
CASE WHEN cur.file_path IS NULL THEN 'delete' WHEN old.file_path IS NULL OR old.file_hash IS NULL THEN 'insert' ELSE 'update' END AS action
FROM cur FULL JOIN old ON cur.repo_path = old.repo_path AND cur.file_path = old.file_path
WHERE cur.file_path IS NULL OR old.file_path IS NULL OR old.file_hash IS NULL OR cur.file_hash IS DISTINCT FROM old.file_hash"""


@query(_DIFF)
def diff_repo_and_db(spark, d):
    return S.diff(versions(spark, d), versions(spark, d, CUT), ["repo_path", "file_path"], "file_hash")


@query(f"SELECT count(*) FILTER (action IN ('insert', 'update')) AS inserted, count(*) FILTER (action IN ('delete', 'update')) AS deleted FROM ({_DIFF})")
def sync_counters(spark, d):
    a = F.col("action")
    return diff_repo_and_db(spark, d).agg(F.count_if(a.isin("insert", "update")).alias("inserted"), F.count_if(a.isin("delete", "update")).alias("deleted"))


@query(f"WITH {TEXTS} SELECT file_id FROM tx WHERE file_path NOT IN (SELECT file_path FROM sample_data WHERE content IS NOT NULL AND file_path IS NOT NULL)")
def anti_missing_files(spark, d):
    have = samples(spark, d).where("path is not null").select(F.col("path").alias("file_path")).distinct()
    return texts(spark, d).join(have, "file_path", "left_anti").select("file_id")


@query(f"WITH {SAMPLES} SELECT DISTINCT path FROM ck LEFT JOIN embeddings v ON v.vec_id = ck.file_id WHERE v.vec_id IS NULL")
def semi_missing_embedding(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"))
    return samples(spark, d).join(v, "file_id", "left_anti").select("path").distinct()


@query(f"WITH {SAMPLES} SELECT count(*) AS n_rows, count(*) FILTER (v.vec_id IS NULL) AS n_missing FROM ck LEFT JOIN embeddings v ON v.vec_id = ck.file_id")
def count_missing_embedding(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), "vec_id")
    return samples(spark, d).join(v, "file_id", "left").agg(F.count("*").alias("n_rows"), F.count_if(F.col("vec_id").isNull()).alias("n_missing"))


@query(f"WITH {CUR}, {OLD} SELECT repo_path, file_path, file_hash FROM old UNION ALL SELECT repo_path, file_path, file_hash FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.repo_path = cur.repo_path AND old.file_path = cur.file_path)")
def merge_prefer_existing(spark, d):
    keep = ["repo_path", "file_path", "file_hash"]
    return S.upsert(versions(spark, d).select(*keep), versions(spark, d, CUT).select(*keep), ["repo_path", "file_path"])


@query(f"WITH {CUR}, {OLD} SELECT coalesce(cur.repo_path, old.repo_path) AS repo_path, coalesce(cur.file_path, old.file_path) AS file_path, coalesce(cur.file_hash, old.file_hash) AS file_hash FROM cur FULL JOIN old ON cur.repo_path = old.repo_path AND cur.file_path = old.file_path")
def overlay_update_hashes(spark, d):
    a = versions(spark, d).select("repo_path", "file_path", F.col("file_hash").alias("n"))
    b = versions(spark, d, CUT).select("repo_path", "file_path", F.col("file_hash").alias("o"))
    return a.join(b, ["repo_path", "file_path"], "full_outer").select("repo_path", "file_path", F.coalesce("n", "o").alias("file_hash"))


@query("SELECT r.run_id, coalesce(p.pos, 99) AS pos FROM (SELECT DISTINCT run_id, extract('dow' FROM started_at AT TIME ZONE 'UTC') AS dow FROM index_runs) r LEFT JOIN (VALUES (1, 0), (3, 1), (5, 2)) p(dow, pos) USING (dow)")
def settings_order_join(spark, d):
    """Order by configured position, unknown last."""
    pos = spark.createDataFrame([(1, 0), (3, 1), (5, 2)], "dow int, pos int")
    r = read(spark, d, "index_runs").select("run_id", (F.dayofweek("started_at") - 1).alias("dow")).distinct()
    return r.join(F.broadcast(pos), "dow", "left").select("run_id", F.coalesce("pos", F.lit(99)).alias("pos")).orderBy("pos")


@query(f"WITH {SYMBOLS}, hit AS (SELECT file_id, min(id) AS first_id FROM sy WHERE category = 'function' AND file_id > 0 GROUP BY 1), imp AS (SELECT file_id, count(*) AS n FROM sy WHERE category = 'import' GROUP BY 1) SELECT hit.file_id, first_id, coalesce(n, 0) AS n_imports FROM hit LEFT JOIN imp USING (file_id)")
def join_focus_chunks(spark, d):
    sy = symbols(spark, d)
    hit = sy.where("category = 'function' and file_id > 0").groupBy("file_id").agg(F.min("id").alias("first_id"))
    imp = sy.where("category = 'import'").groupBy("file_id").agg(F.count("*").alias("n"))
    return hit.join(imp, "file_id", "left").select("file_id", "first_id", F.coalesce("n", F.lit(0)).alias("n_imports"))


# aggregates
@query(f"WITH {SAMPLES}, t AS (SELECT *, count(*) OVER (PARTITION BY path) AS total FROM ck) SELECT path FROM t WHERE created_at >= TIMESTAMPTZ '2025-03-15 00:00:00+00' GROUP BY path HAVING count(*) = min(total)")
def file_completeness(spark, d):
    """Files of which all chunks are still there after older ones went."""
    ck = samples(spark, d)
    t = ck.join(ck.groupBy("path").agg(F.count("*").alias("total")), "path").where(F.col("created_at") >= _ts("2025-03-15 00:00:00"))
    return S.complete_files(t, "path", "total")


@query(f"WITH {SAMPLES} SELECT fn IS NULL AS no_fn, cls IS NULL AS no_cls, count(*) AS n FROM ck GROUP BY ALL")
def symbols_from_hierarchy(spark, d):
    """Functions and classes of a hierarchy of (type, value), each value once."""
    h = samples(spark, d).select("id", F.array(F.struct(F.lit("function").alias("type"), F.col("fn").alias("value")), F.struct(F.lit("class").alias("type"), F.col("cls").alias("value"))).alias("h"))
    s = h.select(L.values_of("h", "function").alias("f"), L.values_of("h", "class").alias("c"))
    return s.groupBy((F.size("f") == 0).alias("no_fn"), (F.size("c") == 0).alias("no_cls")).agg(F.count("*").alias("n"))


@query(f"WITH {SYMBOLS} SELECT DISTINCT file_id, category, node_name FROM sy WHERE category IN ('class', 'function') AND node_name IS NOT NULL AND file_id IN (SELECT file_id FROM sy WHERE category = 'import')")
def import_rollup(spark, d):
    """What import-only chunks receive: the distinct classes and functions of their file, one row each."""
    sy = symbols(spark, d).where("file_id is not null")
    imp = sy.where("category = 'import'").select("file_id").distinct()
    return sy.where("category in ('class', 'function') and node_name is not null").join(imp, "file_id", "left_semi").select("file_id", "category", "node_name").distinct()


@query(f"WITH {SYMBOLS} SELECT file_id, min(start_line) AS s, max(end_line) AS e, sum(end_line - start_line) AS size, bool_and(category = 'import') AS import_only, bool_or(parent_name IS NULL) AS top_level FROM sy WHERE file_id IS NOT NULL GROUP BY 1")
def span_monoid(spark, d):
    g = symbols(spark, d).where("file_id is not null").groupBy("file_id")
    return g.agg(
        F.min("start_line").alias("s"), F.max("end_line").alias("e"), F.sum((F.col("end_line") - F.col("start_line")).cast("bigint")).alias("size"), F.bool_and(F.col("category") == "import").alias("import_only"), F.bool_or(F.col("parent_name").isNull()).alias("top_level")
    )


@query(f"WITH {TEXTS} SELECT file_id, file_path, count(*) OVER () AS total FROM tx WHERE contains(file_path, 'gate') ORDER BY file_path, file_id LIMIT 100")
def total_matches(spark, d):
    hit = texts(spark, d).where(F.col("file_path").contains("gate")).select("file_id", "file_path")
    return hit.orderBy("file_path", "file_id").limit(100).crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))


@query("SELECT day, n, round(sum(n) OVER (ORDER BY day) / sum(n) OVER (), 9) AS done FROM (SELECT strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM files GROUP BY 1)")
def progress_fraction(spark, d):
    """Share of the feed that had arrived by the end of each day; one row per day, so one window holds them."""
    day = read(spark, d, "files").groupBy(F.date_format("arrived_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    return day.select("day", "n", F.round(F.sum("n").over(w) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 9).alias("done"))


# sets, sorts, limits
@query(f"WITH {SAMPLES} SELECT id FROM ck UNION ALL SELECT CAST(file_id AS VARCHAR) FROM repo_files")
def union_all_lists(spark, d):
    return samples(spark, d).select("id").unionByName(read(spark, d, "repo_files").select(F.col("file_id").cast("string").alias("id")))


@query("SELECT DISTINCT md5(content) AS h FROM (SELECT content FROM sample_data UNION ALL SELECT content FROM repo_files)")
def union_distinct_content(spark, d):
    both = read(spark, d, "sample_data").select(F.md5("content").alias("h")).unionByName(read(spark, d, "repo_files").select(F.md5("content").alias("h")))
    return both.distinct()


@query("SELECT file_path FROM files INTERSECT SELECT file_path FROM repo_files")
def intersect_allowlist(spark, d):
    return read(spark, d, "files").select("file_path").intersect(read(spark, d, "repo_files").select("file_path"))


@query("SELECT file_path FROM files WHERE file_path IS NOT NULL EXCEPT SELECT file_path FROM repo_files")
def except_servers(spark, d):
    known = read(spark, d, "repo_files").select("file_path")
    return read(spark, d, "files").where("file_path is not null").select("file_path").distinct().join(known, "file_path", "left_anti")


@query("SELECT DISTINCT language FROM files")
def distinct_sorted(spark, d):
    return read(spark, d, "files").select("language").distinct().orderBy("language")


@query(f"WITH {SAMPLES} SELECT id, path, s FROM ck")
def sort_path_line(spark, d):
    return samples(spark, d).select("id", "path", "s").orderBy("path", "s", "id")


@query(f"WITH {SYMBOLS} SELECT id, file_id, start_line FROM sy")
def sort_symbols(spark, d):
    return symbols(spark, d).select("id", "file_id", "start_line").orderBy("file_id", "start_line", "id")


@query(f"WITH {TEXTS} SELECT file_path, file_id, NULL::BIGINT AS rest FROM (SELECT * FROM tx ORDER BY file_path, file_id LIMIT 100) UNION ALL SELECT '...', NULL, count(*) - 100 FROM tx HAVING count(*) > 100")
def limits(spark, d):
    """The first hundred paths and, if there are more, a row that says how many."""
    return L.capped(texts(spark, d).select("file_path", "file_id"), ["file_path", "file_id"], 100)


@query(f"WITH {SAMPLES} SELECT id FROM ck QUALIFY row_number() OVER (PARTITION BY path, s, e ORDER BY id) = 1")
def dedup_denotation(spark, d):
    return samples(spark, d).groupBy("path", "s", "e").agg(F.min("id").alias("id")).select("id")


@query(f"WITH {SYMBOLS} SELECT max(id) AS id, start_line FROM sy WHERE file_id > 0 GROUP BY file_id, start_line")
def dedup_keep_last(spark, d):
    return symbols(spark, d).where("file_id > 0").groupBy("file_id", "start_line").agg(F.max("id").alias("id")).select("id", "start_line")


@query(f"WITH {SYMBOLS} SELECT file_id, node_type, node_name, min(id) AS id FROM sy WHERE file_id > 0 AND node_type IS NOT NULL AND node_name IS NOT NULL GROUP BY ALL")
def dedup_hierarchy(spark, d):
    """The first mention of each (type, name) of a file."""
    h = symbols(spark, d).where("file_id > 0 and node_type is not null and node_name is not null")
    return h.groupBy("file_id", "node_type", "node_name").agg(F.min("id").alias("id"))


@query("SELECT file_path, (row_number() OVER (ORDER BY file_path) - 1) // 200 AS batch FROM (SELECT DISTINCT file_path FROM files)")
def batchify(spark, d):
    n = S.numbered(read(spark, d, "files").select("file_path").distinct(), ["file_path"], "k", 0)
    return n.select("file_path", F.floor(F.col("k") / 200).alias("batch"))
