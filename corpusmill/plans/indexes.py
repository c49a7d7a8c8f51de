"""Stored indexes over the tables, each built once for a session and a folder of tables and then read by every query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import search as S
from corpusmill.operators.textindex import TextIndex, text_terms
from corpusmill.session import read, scratch

from .tables import samples

_built: dict[tuple, TextIndex] = {}


def _once(spark, d, name, make) -> TextIndex:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _built:
        _built[key] = make(f"{scratch(spark)}/{name}")
    return _built[key]


def documents(spark, d) -> TextIndex:
    """Tokens of documents.text by doc_id; keeps the title."""
    title = F.concat(F.coalesce("source", F.lit("?")), F.lit("/"), F.coalesce("repo_path", F.lit("?")))
    x = lambda: text_terms(read(spark, d, "documents").select("doc_id", title.alias("title"), "text"), "text").select("doc_id", "title", "_terms")
    return _once(spark, d, "documents", lambda f: TextIndex(spark, f).build(x(), "doc_id", ["title"]))


def chunk_texts(spark, d) -> TextIndex:
    """Tokens of the stored chunks' texts by their hash, each text once."""
    x = lambda: text_terms(samples(spark, d).groupBy("chunk_hash").agg(F.first("text").alias("text")), "text").select("chunk_hash", "_terms")
    return _once(spark, d, "chunks", lambda f: TextIndex(spark, f).build(x(), "chunk_hash"))


def keywords(spark, d) -> TextIndex:
    """Character trigrams of the functions, classes and paths of stored chunks by their id."""
    both = F.concat_ws(" ", "fn", "cls", "path")
    x = lambda: samples(spark, d).select("id", S.trigrams(both).alias("_terms"))
    return _once(spark, d, "keywords", lambda f: TextIndex(spark, f, empty_count=False).build(x(), "id"))
