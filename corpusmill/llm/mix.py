"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected the same number of times: the source's share of the mixture over the
source's size. Documents are ordered by size, the expected copies are summed up along that order, one random offset is
added, and a document is emitted once for every integer that its stretch of the sum crosses. So a source's documents
of every size are used evenly, and its tokens come out very near their target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.operators.prefix import range_parts, with_carry
from corpusmill.session import checkpoint

from .bpe import DEFAULT_VOCABULARY, count_tokens

#: Targets are joined by broadcast up to this many, beyond by a shuffled join.
BROADCAST_SOURCES = 10_000


def normal_source(source: Column) -> Column:
    """Source names in one spelling: trimmed, lower case, runs of punctuation and white space as `_`; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def one_per_source(targets: DataFrame) -> DataFrame:
    """source (one spelling), weight, max_repeats; of rows with one source the greatest weight holds."""
    t = targets.select(normal_source(F.col("source")).alias("source"), F.struct(F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats")).alias("t"))
    return t.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("t").alias("t")).select("source", "t.*")


def plan_copies(targets: DataFrame, sizes: DataFrame, total: float | None = None) -> DataFrame:
    """source, weight_present (among the sources with tokens), target_tokens, expected copies per document, of sources
    (source, weight, max_repeats) with tokens (source, n).

    Weights of sources without tokens, or that may not be used, go to the others in proportion. Without a `total` the
    mixture is as large as the repeat limits allow with every weight exact; with one, a source that reaches its limit
    stays short and the shortfall shows in the report.
    """
    m = F.col("max_repeats")
    live = targets.join(sizes, "source").where((F.col("weight") > 0) & (m.isNull() | (m > 0)) & (F.col("n") > 0))
    live = live.crossJoin(F.broadcast(live.agg(F.sum("weight").alias("_whole")))).withColumn("weight_present", F.col("weight") / F.col("_whole"))
    most = live.agg(F.coalesce(F.min(F.col("n") * m / F.col("weight_present")), F.sum("n").cast("double")).alias("_total"))
    want = live.crossJoin(F.broadcast(most)).withColumn("target_tokens", (F.col("_total") if total is None else F.lit(float(total))) * F.col("weight_present"))
    copies = F.col("target_tokens") / F.col("n")
    near = F.round(copies)
    expected = F.when(copies > m - 1e-9, m.cast("double")).when(F.abs(copies - near) < 1e-9, near).otherwise(copies)
    return want.select("source", "weight_present", "target_tokens", expected.alias("expected"))


def _small(per_source: DataFrame) -> DataFrame:
    """The table of one row per source, marked for broadcast if it is small enough."""
    return F.broadcast(per_source) if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per_source


def sized_documents(docs: DataFrame, targets: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source (one spelling), n_tokens of the documents whose source has a target; checkpointed, since the
    sizes are needed for the totals and again for the sums."""
    t = targets.select(normal_source(F.col("source")).alias("source")).distinct()
    d = docs.select("doc_id", normal_source(F.col("source")).alias("source"), "text").join(_small(t), "source", "left_semi")
    return checkpoint(count_tokens(d, ["doc_id", "source"], "text", path))


def mix(docs: DataFrame, targets: DataFrame, path: str = DEFAULT_VOCABULARY, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). uses: doc_id, source, n_tokens, copies of every document of a listed source, also of the unused
    ones; documents without tokens are never used. shares: one row per target with what was wanted and reached.

    A source with a third of all rows is spread over range partitions; a partition's count carries over to the next.
    If a target is listed twice its greatest weight holds.
    """
    listed = one_per_source(targets)
    sized = sized_documents(docs, targets, path)
    plan = plan_copies(listed, sized.groupBy("source").agg(F.sum("n_tokens").alias("n")), total)
    offset = F.xxhash64(F.lit(seed), F.col("source")).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    plan = checkpoint(plan.withColumn("offset", offset))
    parts = range_parts(sized.where(F.col("n_tokens") > 0), ["source", "n_tokens", "doc_id"])
    parts = with_carry(parts, ["source"], F.count("*"), F.sum)
    w = Window.partitionBy("source", "_part").orderBy("n_tokens", "doc_id")
    rank = F.row_number().over(w) + F.coalesce("_carry", F.lit(0))
    reach = lambda k: F.floor(F.col("expected") * k + F.col("offset"))
    used = (
        parts.withColumn("rank", rank).join(_small(plan), "source", "left")
        .select("doc_id", "source", "n_tokens", F.coalesce(reach(F.col("rank")) - reach(F.col("rank") - 1), F.lit(0)).cast("int").alias("copies"))
    )
    used = used.unionByName(sized.where(F.col("n_tokens") == 0).select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")))
    goal = listed.join(plan.select("source", "weight_present", "target_tokens"), "source", "left").na.fill(0.0, ["weight_present", "target_tokens"])
    per = used.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens_available"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_repeats")
    )
    shares = goal.join(per, "source", "left").na.fill(0, ["n_docs", "tokens_available", "tokens_used", "most_repeats"])
    shares = shares.crossJoin(F.broadcast(per.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("_all"))))
    shares = shares.withColumn("share", F.when(F.col("_all") > 0, F.col("tokens_used") / F.col("_all")).otherwise(F.lit(0.0))).drop("_all")
    return used, shares
