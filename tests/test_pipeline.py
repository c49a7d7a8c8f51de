"""Handlers from files to documents, and the plug-in points."""

import pytest
from pyspark.sql import functions as F

from corpusmill import interfaces as I
from corpusmill.operators import embed, pipeline as P

FILES = [("a.py", "1", "import os\n\n\ndef f():\n    return 1\n", "python"), ("b.go", "1", "x\n" * 60, None), ("c.py", "1", None, "python"), ("d.py", "1", "", "python")]


def test_handlers(spark):
    files = spark.createDataFrame(FILES, "path string, file_hash string, content string, lang string")
    chunks, docs = P.create_chunks_and_docs(P.PlainHandler(), files)
    got = chunks.collect()
    assert {r["path"] for r in got} == {"a.py", "b.go"} and all(r["vector"] is None for r in got)
    by = {r["path"]: r for r in got}
    assert by["a.py"]["functions"] == ["f"] and by["b.go"]["total_chunks"] == 2
    titles = {r["title"]: r["content"] for r in docs.collect()}
    assert "b.go:1-51" in titles and "functions: f" in next(v for k, v in titles.items() if k.startswith("a.py"))
    made = []

    def embedded(x):
        made.append(sorted({r["path"] for r in x.collect()}))
        return embed.embed(x.select("chunk_hash", "text").distinct(), "chunk_hash", "text")

    full = P.StoreHandler(chunks.limit(0), embedded).create_chunks(files).cache()
    assert made[-1] == ["a.py", "b.go"] and full.where("vector is null").count() == 0
    again = P.StoreHandler(full, embedded).create_chunks(files)
    assert made[-1] == [] and sorted(map(str, again.collect())) == sorted(map(str, full.collect()))
    lost = full.where("not (path = 'b.go' and start = 1)").withColumn("vector", F.when(F.col("path") != "a.py", F.col("vector")))
    P.StoreHandler(lost, embedded).create_chunks(files)
    assert made[-1] == ["a.py", "b.go"]
    changed = files.withColumn("file_hash", F.when(F.col("path") == "a.py", "2").otherwise(F.col("file_hash")))
    P.StoreHandler(full, embedded).create_chunks(changed)
    assert made[-1] == ["a.py"]


def test_interfaces(spark, tmp_path):
    threads = I.TableThreads(spark, str(tmp_path / "t"))
    threads.append(spark.createDataFrame([(2, 7, "main"), (1, 7, "main"), (3, 8, "side")], "id bigint, session_id bigint, call_chain_category string"))
    assert [r["id"] for r in threads.of_session(7, "main").collect()] == [1, 2] and [r["id"] for r in threads.by_ids([3, 1]).collect()] == [1, 3]
    now = [0.0]
    cache = I.TimedCache(2, 10, lambda: now[0])
    for k in "abc":
        cache.set(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 11
    assert cache.get("c") is None
    stop = I.Cancellation()
    stop.check()
    stop.cancel()
    with pytest.raises(I.Cancelled):
        stop.check()
