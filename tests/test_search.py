"""The stored index against the direct score; composites on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search as S
from corpusmill.operators.textindex import TextIndex, text_terms

DOCS = [(1, "retry the search tool"), (2, "searchTool retry_policy retry"), (3, None), (4, ""), (5, "nothing here"), (6, "the the the search")]


def test_index_equals_direct_score(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id bigint, text string")
    ix = TextIndex(spark, str(tmp_path / "ix"), buckets=3).build(text_terms(docs, "text").select("id", "_terms"), "id")
    for q in ("retry search", "the search tool retry retry", "Ünknown", ""):
        want = {r["id"]: round(r["score"], 9) for r in S.bm25(docs, "id", "text", q).collect()}
        got = {r["key"]: round(r["score"], 9) for r in ix.bm25({0: S.counted_terms(spark, q)}).collect()}
        assert got == want, q
    many = ix.bm25({0: {"retry": 1}, 1: {"search": 2, "retry": 1}, 2: {"zzz": 1}}).collect()
    assert {r["query"] for r in many} == {0, 1} and {r["key"] for r in many if r["query"] == 0} == {1, 2}
    assert TextIndex(spark, str(tmp_path / "ix"), buckets=3).stats() == (6, sum(r["dl"] for r in ix.keys().collect()))
    files = {f.rpartition("/")[2] for r in ix._postings(["retry"]).inputFiles() for f in [r]}
    assert files  # the bucket of one term
    empty = TextIndex(spark, str(tmp_path / "none"), buckets=3).build(text_terms(docs.limit(0), "text").select("id", "_terms"), "id")
    assert empty.stats() == (0, 0)


def test_vectordb_search(spark):
    """Whitelist, fusion, first place, imports of the hits' files, each content once, order."""
    files = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, file_hash string")
    cf = spark.createDataFrame(
        [(1, "b", "1", "h1", 5, False), (2, "a", "1", "h1", 9, False), (3, "a", "1", "h2", 1, True), (4, "b", "1", "h3", 0, True), (5, "b", "0", "h4", 1, False), (6, "c", "1", "h5", 1, False), (7, "b", "1", "h3", 7, True)],
        "id bigint, path string, file_hash string, chunk_hash string, s int, import_only boolean",
    )
    score = lambda *x: spark.createDataFrame(list(x), "chunk_hash string, score double")
    got = S.search("vector_db", files=files, chunk_files=cf, lexical=score(("h1", 2.0), ("h5", 9.0)), vector=score(("h1", 0.5), ("h2", 0.4), ("h4", 9.0)), limit=1).collect()
    assert [(r["id"], r["path"], r["s"], r["score"] is None) for r in got] == [(4, "b", 0, True), (1, "b", 5, False)]
    without = S.vectordb_search(files, cf, score(("h1", 2.0)), score(("h2", 0.4)), 9, with_imports=False).collect()
    assert [r["id"] for r in without] == [3, 1]
    with pytest.raises(ValueError, match="needs"):
        S.search("vector_db", files=files)
    with pytest.raises(ValueError, match="unknown"):
        S.search("other")


def test_snippets_and_autocomplete(spark):
    ck = spark.createDataFrame([("1", "A", None, 9, "p"), ("2", "A", None, 3, "q"), ("3", None, "f", 1, "p"), ("4", "B", "f", 2, "q")], "id string, cls string, fn string, s int, path string")
    terms = spark.createDataFrame([(0, "A", "class"), (1, "f", "function"), (2, "zz", "class"), (3, "A", "file")], "query int, keyword string, type string")
    hits = spark.createDataFrame([(q, "4", 1.0) for q in range(4)], "query int, id string, score double")
    got = sorted((r["query"], r["id"]) for r in S.focussed_snippets(hits, ck, terms).collect())
    assert got == [(0, "1"), (0, "2"), (1, "3"), (1, "4"), (2, "4"), (3, "4")]
    assert [r["id"] for r in S.exact_symbols(ck, terms, 1).where("query = 0").collect()] == ["2"]
    scored = spark.createDataFrame([("1", 9.0), ("2", 8.0), ("3", 7.0)], "id string, score double")
    allowed = spark.createDataFrame([("q",)], "path string")
    assert [r["id"] for r in S.autocomplete(scored, "id", ck.select("id", "path"), allowed, ["path"], 1).collect()] == ["2"]
    assert [r["id"] for r in S.autocomplete(scored, "id", ck.select("id", "path"), allowed, ["path"], 1, pre_filter_limit=1).collect()] == ["2"]
    focus, related = ck.where("id = '1'").select("id", "fn"), ck.select("id", "fn")
    assert {(r["id"], r["origin"]) for r in S.relevant_chunks(focus, related.where(F.col("fn").isNotNull()), "fn").collect()} == {("1", "focus"), ("3", "related"), ("4", "related")}
