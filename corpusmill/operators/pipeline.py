"""From files to chunks and documents: handlers that put the chunking operators together, with or without a store."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions.text import line_range, xxh64_hex
from corpusmill.operators import chunking, store

#: Columns of a chunk: where it lies, its text and hash, what is named in it.
CHUNK_COLUMNS = ["path", "file_hash", "start", "end", "chunk_hash", "text", "classes", "functions", "import_only", "total_chunks"]


class ChunkerHandler(Protocol):
    def create_chunks(self, files: DataFrame) -> DataFrame:
        """Chunks (CHUNK_COLUMNS and vector) of files (path, file_hash, content, lang)."""


def cut_files(files: DataFrame, most: int = 1200) -> DataFrame:
    """CHUNK_COLUMNS of every file with content; a chunk's text is its lines, which leave no task without it. Files are keyed by
    path and hash; null contents have no chunks."""
    keyed = files.where(F.col("content").isNotNull()).withColumn("k", F.struct("path", "file_hash", "content"))
    spans = chunking.chunk_source(keyed, "k", "content", "lang", most)
    text = line_range(F.col("k.content"), F.col("start"), F.col("end"))
    cut = spans.select("k.path", "k.file_hash", "start", "end", xxh64_hex(text).alias("chunk_hash"), text.alias("text"), "classes", "functions", "import_only")
    total = cut.groupBy("path", "file_hash").agg(F.count("*").alias("total_chunks"))
    return cut.join(total, ["path", "file_hash"]).select(*CHUNK_COLUMNS)


class PlainHandler:
    """Every file is cut up; nothing is stored, and chunks have no vectors."""

    def __init__(self, most: int = 1200):
        self.most = most

    def create_chunks(self, files: DataFrame) -> DataFrame:
        return cut_files(files, self.most).withColumn("vector", F.lit(None).cast("array<float>"))


class StoreHandler:
    """Only what the store does not have whole is cut up and embedded: files that are new or changed, that lack chunks, or
    of which a chunk lacks its vector. What is stored of the others wins over what would be made anew."""

    def __init__(self, stored: DataFrame, embed: Callable[[DataFrame], DataFrame], most: int = 1200):
        """`stored` has CHUNK_COLUMNS and vector; `embed(chunks)` gives chunk_hash and vector."""
        self.stored, self.embed, self.most = stored, embed, most

    def create_chunks(self, files: DataFrame) -> DataFrame:
        keys = ["path", "file_hash"]
        here = self.stored.join(files.select(*keys).distinct(), keys, "left_semi")
        g = here.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("total_chunks").alias("_t"), F.count_if(F.col("vector").isNull()).alias("_v"))
        whole = g.where((F.col("_n") == F.col("_t")) & (F.col("_v") == 0)).select(*keys)
        made = cut_files(files.join(whole, keys, "left_anti"), self.most)
        made = made.join(self.embed(made), "chunk_hash", "left").select(*CHUNK_COLUMNS, "vector")
        return store.upsert(made, here.join(whole, keys, "left_semi").select(*made.columns), keys)


def documents_of(chunks: DataFrame) -> DataFrame:
    """title (`path:start-end`) and content of each chunk with its path and names before its code."""
    names = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("<meta_data>\npath: "), "path", F.lit("\n"), names("classes", "classes"), names("functions", "functions"), F.lit("</meta_data>\n<code>\n"), "text", F.lit("\n</code>"))
    return chunks.select(F.concat("path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("title"), head.alias("content"))


def create_chunks_and_docs(handler: ChunkerHandler, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    chunks = handler.create_chunks(files)
    return chunks, documents_of(chunks)
