"""Globally sorted parts with prefix-combined summaries.

A global order is cut into range partitions, whose rows carry their part number. What a row needs from the rows before
it splits into what lies in its own part (a window within the part) and what the parts before contribute (a fold over
one summary row per part). No task ever holds a whole hot entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.session import checkpoint, shuffle_partitions


def range_parts(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """`df` range-partitioned by `keys`, with its part number in `_part`; checkpointed, since range bounds come from a
    sample and must be the same for the summaries and for the rescan, also after the loss of an executor."""
    n = parts or shuffle_partitions(df.sparkSession)
    return checkpoint(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))


def carried(parts: DataFrame, entity: list[str], summary: Column, combine) -> DataFrame:
    """entity, _part, _carry: `combine` of the summaries of the entity's earlier parts (null in its first part).

    There is one summary row per entity and part that it touches: a third of all rows under one entity still is at
    most one row per part.
    """
    s = parts.groupBy(*entity, "_part").agg(summary.alias("_sum"))
    w = Window.partitionBy(*entity).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return s.select(*entity, "_part", combine("_sum").over(w).alias("_carry"))


def with_carry(parts: DataFrame, entity: list[str], summary: Column, combine) -> DataFrame:
    """`parts` with the carried state of its entity and part. Only carries that exist are joined, and those are few:
    an entity has one for each part beyond its first."""
    c = carried(parts, entity, summary, combine).where(F.col("_carry").isNotNull())
    return parts.join(c, [*entity, "_part"], "left")
