"""Merging overlapping intervals per entity and listing the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.operators.prefix import range_parts, with_carry


def valid_intervals(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """e, s, t (inclusive bounds): entity > 0, both bounds given, start >= 1, end >= start. Of intervals with the same
    start only the longest is kept, which partial aggregation does before the shuffle and which loses no covered line."""
    ok = (F.col(entity) > 0) & (F.col(start) >= 1) & (F.col(end) >= F.col(start))
    return (
        df.where(ok)
        .groupBy(F.col(entity).cast("bigint").alias("e"), F.col(start).cast("bigint").alias("s"))
        .agg(F.max(F.col(end).cast("bigint")).alias("t"))
    )


def covered_before(intervals: DataFrame, parts: int | None = None) -> DataFrame:
    """e, s, t, before: the greatest end among the entity's intervals that sort before this one (null for the first).

    Intervals are range-sorted by (entity, start); each part gives its maximum end per entity, the summaries are
    prefix-combined over the parts, and the rescan combines the carried maximum with the running one in the part.
    """
    p = with_carry(range_parts(intervals, ["e", "s"], parts), ["e"], F.max("t"), F.max)
    w = Window.partitionBy("e", "_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("before", F.greatest(F.max("t").over(w), F.col("_carry"))).select("e", "s", "t", "before", "_part")


def gaps(df: DataFrame, entity: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """entity, gap_start, gap_end: maximal uncovered runs between two intervals of an entity, bounds inclusive.

    Touching intervals leave no gap. Nulls and impossible bounds are ignored, so an entity without a valid interval has
    no row, and an empty table gives no row.
    """
    b = covered_before(valid_intervals(df, entity, start, end), parts)
    return b.where(F.col("s") > F.col("before") + 1).select(
        F.col("e").alias(entity), (F.col("before") + 1).alias("gap_start"), (F.col("s") - 1).alias("gap_end")
    )


def merged(df: DataFrame, entity: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """entity, period_start, period_end, n_starts: continuous stretches; overlapping, nested and touching ones merge.

    A row that begins a stretch gets a label from the count of such rows before it: in its part, plus those of the
    earlier parts.
    """
    b = covered_before(valid_intervals(df, entity, start, end), parts)
    b = b.withColumn("begins", F.when(F.col("before").isNull() | (F.col("s") > F.col("before") + 1), 1).otherwise(0))
    b = with_carry(b, ["e"], F.sum("begins"), F.sum)
    w = Window.partitionBy("e", "_part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("island", F.sum("begins").over(w) + F.coalesce("_carry", F.lit(0)))
    return (
        b.groupBy("e", "island")
        .agg(F.min("s").alias("period_start"), F.max("t").alias("period_end"), F.count("*").alias("n_starts"))
        .select(F.col("e").alias(entity), "period_start", "period_end", "n_starts")
    )
