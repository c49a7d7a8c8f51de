"""A stored inverted index: texts are cut up once, and a query reads the buckets of its own terms.

`postings` has one row per occurrence of a term with the text's length, in folders by the hash of the term and sorted by
term and text within, so a query's scan is pruned to a few folders and row groups, and counts only its own terms. A term that very many texts have is
spread over files by the hash of the text. `keys` has the texts' keys, lengths and whatever columns results should carry,
and `stats` the numbers of the collection. Building shuffles terms once; texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions.text import with_tokens
from corpusmill.session import spread

K1, B = 1.2, 0.75
#: Files that the postings of one bucket are spread over.
SPREAD = 4


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextIndex:
    """Built by `build`, opened by its folder. Keys are unique; a null text has no terms and the length 0.

    `empty_count` says whether texts without terms count among the collection's documents, as they do for whole documents
    and do not for keyword fields.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, empty_count: bool = True):
        self.spark, self.folder, self.buckets, self.empty_count = spark, folder.rstrip("/"), buckets, empty_count
        self._stats: tuple[int, int] | None = None

    def build(self, terms: DataFrame, key: str, keep: list[str] | None = None) -> "TextIndex":
        """Write the index of `terms`: key, _terms (array of terms with repetitions), and columns to keep."""
        rows = terms.select(F.col(key).alias("key"), F.coalesce(F.size("_terms"), F.lit(0)).alias("dl"), "_terms", *(keep or []))
        rows.drop("_terms").write.parquet(f"{self.folder}/keys")
        # an outer explode: for an inner one the optimizer would test the array's size below, cutting up the texts again
        one = rows.select("key", "dl", F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
        one = one.withColumn("bucket", _bucket(F.col("term"), self.buckets)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
        one.repartition("bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{self.folder}/postings")
        counted = self.keys() if self.empty_count else self.keys().where("dl > 0")
        counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total")).write.parquet(f"{self.folder}/stats")
        return self

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/keys")

    def _postings(self, terms: list[str]) -> DataFrame:
        """key, term, dl, tf of some terms; only their buckets are read."""
        if not terms:
            return self.spark.createDataFrame([], "key string, term string, dl int, tf bigint")
        key = self.keys().schema["key"].dataType.simpleString()
        p = self.spark.read.schema(f"term string, key {key}, dl int, bucket int").parquet(f"{self.folder}/postings")
        of = self.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(_bucket(F.col("t"), self.buckets)).distinct()
        return p.where(F.col("bucket").isin([r[0] for r in of.collect()]) & F.col("term").isin(terms)).groupBy("key", "term").agg(F.first("dl").alias("dl"), F.count("*").alias("tf"))

    def stats(self) -> tuple[int, int]:
        """(documents, total length)"""
        if self._stats is None:
            self._stats = tuple(self.spark.read.parquet(f"{self.folder}/stats").first())
        return self._stats

    def bm25(self, queries: dict[int, dict[str, int]]) -> DataFrame:
        """query, key, score of the texts that have a term of a query; queries are {number: {term: count}} and all are
        answered in one scan. A query's terms and their document frequencies, one row each, are all that is read to the
        driver."""
        terms = sorted({t for q in queries.values() for t in q})
        hits = self._postings(terms)
        n, total = self.stats()
        df = {r[0]: r[1] for r in hits.groupBy("term").agg(F.count("*")).collect()}
        weights: dict[str, list[Column]] = {}
        for k, q in queries.items():
            for t, c in q.items():
                if t in df:
                    weights.setdefault(t, []).append(F.struct(F.lit(k).alias("query"), F.lit(c * (K1 + 1) * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)).alias("weight")))
        if not weights:
            return hits.limit(0).select(F.lit(0).alias("query"), "key", F.lit(0.0).alias("score"))
        table = F.create_map(*[x for t, ws in sorted(weights.items()) for x in (F.lit(t), F.array(*ws))])
        norm = K1 * (1 - B + B * F.col("dl") / F.lit(total / n if n else 1.0))
        rows = hits.select("key", "tf", "dl", F.explode(F.element_at(table, F.col("term"))).alias("w"))
        return rows.groupBy("w.query", "key").agg(F.sum(F.col("w.weight") * F.col("tf") / (F.col("tf") + norm)).alias("score"))


def text_terms(docs: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """`docs` with _terms: unigrams, bigrams and trigrams of a text column."""
    return with_tokens(spread(docs.withColumn("_text", F.col(text))), "_text", "_terms", strict)
