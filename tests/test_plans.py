"""Queries whose plans SQL does not check."""

import os
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.search import LlmReranker
from corpusmill.plans import lines, sources, store
from corpusmill.session import scratch
from corpusmill.streaming.incremental import index_stream


def test_token_bin_pack(spark, tmp_path):
    rows = [(i, "w " * 150) for i in range(60)] + [(60, "w " * 3000), (61, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # one file a task
    try:
        got = sources.token_bin_pack(spark, str(tmp_path)).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    size, docs = Counter(), Counter()
    for r in got:
        size[r["batch"]] += r["n"]
        docs[r["batch"]] += 1
    assert sorted(r["doc_id"] for r in got) == list(range(62))
    assert len({b >> 33 for b in size}) == 3 and all(n <= 2048 or docs[b] == 1 for b, n in size.items())
    assert max(docs.values()) > 4 and len(size) <= 9  # batches go on over Arrow batches


def test_index_stream_ties_and_replay(spark, tmp_path):
    at = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    schema = "id bigint, repo_path string, file_path string, file_hash string, created_at timestamp, arrived_at timestamp"
    got, sunk = [], []

    def feed(row):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(sink):
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream(src, str(tmp_path / "store"), str(tmp_path / "ck"), sink).awaitTermination(60)

    def died(df, n):
        sunk.append(n)
        raise RuntimeError("between commit and sink")

    keep = lambda df, n: got.append((n, [r["id"] for r in df.collect()]))
    feed((1, "/r", "a", "h1", at(0), at(5)))
    run(keep)
    feed((2, "/r", "b", "h1", at(0), at(5)))  # the watermark's own time
    run(keep)
    feed((3, "/r", "c", "h1", at(0), at(3)))  # an earlier one
    with pytest.raises(Exception, match="between commit and sink"):
        run(died)
    run(keep)  # the same batch again
    assert sunk == [2] and got == [(0, [1]), (1, [2]), (2, [3])]


def test_store_snapshot(spark, tmp_path):
    for tbl, n in (("files", 5), ("chunks", 7)):
        spark.range(n).write.parquet(str(tmp_path / f"{tbl}.parquet"))
    base = scratch(spark).rpartition("/")[0].removeprefix("file:")
    left = lambda: {x for x in os.listdir(base) if x.startswith("scratch-")} if os.path.isdir(base) else set()
    before = left()
    assert sorted(map(tuple, store.sqlite_snapshot(spark, str(tmp_path)).collect())) == [("chunks", 7, False, None), ("files", 5, False, None)]
    got = sorted(map(tuple, sources.schema_version_gate(spark, str(tmp_path)).collect()))
    assert got == [(t, i, x) for t in ("chunks", "files") for i, x in enumerate([True, True, False, True])]
    assert left() == before


def test_llm_reranker_refuses_what_it_cannot_show(spark):
    df = spark.range(1001).selectExpr("'d' || id AS name")
    with pytest.raises(ValueError, match="more than 1000"):
        LlmReranker(lambda q, names: names[:1])(df, "name", "q")
    shown = []
    assert LlmReranker(lambda q, names: shown.extend(names) or names[:2])(df.limit(1000), "name", "q").count() == 2
    assert len(shown) == 1000 and shown == sorted(shown)


def test_languages_and_kinds(spark):
    rows = [
        ("a/b.spec.ts", "typescript", "typescript", "code"), ("x.h", "cpp", "c", "code"), ("Dockerfile", "docker", "dockerfile", "code"), ("dockerfile", "unknown", "dockerfile", "code"), ("package.json", "npm-config", "json", "config"),
        ("a.b.TSX", "typescript", "tsx", "code"), (".bashrc", "bash", None, "unknown"), ("x.tar.gz", "archive", None, "unknown"), ("README", "unknown", None, "unknown"), ("m.d/run", "unknown", None, "unknown"), (".env.local", "unknown", None, "config"),
        ("notes.md", "markdown", None, "text"), ("x.mjs", "unknown", "javascript", "unknown"),
    ]
    df = spark.createDataFrame(rows, "p string, guess string, parsed string, kind string")
    L = lines.L
    got = df.select("p", L.guess_language(F.col("p")), L.parser_language(F.col("p")), L.file_type(F.col("p"), F.lit(""))).collect()
    assert list(map(tuple, got)) == rows
    look = spark.createDataFrame([("run", "#!/bin/sh\n", "sampling"), ("run", "import x\n", "code"), ("conf", "key: 1\n", "sampling"), ("a/node_modules/x.py", "x", "not supported"), ("x.PNG", "x", "not supported"), ("d/x.txt", "x", "text")], "p string, t string, want string")
    assert all(r[0] == r[1] for r in look.select(L.summary_kind(F.col("p"), F.col("t"), F.lit(9)), "want").collect())
    assert spark.range(1).select(L.summary_kind(F.lit("a.py"), F.lit(""), F.lit(60 << 20))).first()[0] == "too large"
