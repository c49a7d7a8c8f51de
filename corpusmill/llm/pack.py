"""Filling fixed-capacity containers: sum-of-squares online packing.

For every fill level the number of open containers at that level is kept in a level array. An item goes to the open
level, or to a new container, that makes the sum of the squared counts least; ties go to the fullest. Items larger
than the capacity are first cut into full containers and a rest. Items are spread over independent shards by the hash
of their id, each with its own level array, and shards hold about ITEMS_PER_SHARD items whatever the amount of data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A shard is one task's work. Each shard leaves a few containers open, so larger shards waste less and take longer.
ITEMS_PER_SHARD = 50_000

SCHEMA = "id string, part int, container_id string, n_chars int, offset int"


class LevelPacker:
    """The online packer of one shard: `put(size)` -> (container number, offset in it), for 0 <= size <= capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.made = capacity, np.zeros(capacity + 1, dtype=np.int64), 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.last = -1

    def put(self, size: int) -> tuple[int, int]:
        c = self.capacity
        if size == 0 and self.last >= 0:
            return self.last, 0
        if size >= c:
            self.last = self.made
            self.made += 1
            return self.last, 0
        levels = np.flatnonzero(self.count[: c - size + 1])
        level = 0
        if len(levels):
            after = levels + size
            # change of the sum of squares; a container that becomes full leaves the array
            delta = 2 * (np.where(after < c, self.count[np.minimum(after, c - 1)] + 1, 0) - self.count[levels]) + np.where(after < c, 0, 1)
            k = len(levels) - 1 - int(np.argmin(delta[::-1]))
            if delta[k] <= 2 * self.count[size] + 1:
                level = int(levels[k])
        if level:
            no = self.open[level].pop()
            self.count[level] -= 1
        else:
            no = self.made
            self.made += 1
        if level + size < c:
            if level + size:
                self.open[level + size].append(no)
                self.count[level + size] += 1
        self.last = no
        return no, level


def pack_shard(ids, sizes, shard: int, capacity: int) -> pd.DataFrame:
    p, out = LevelPacker(capacity), []
    for id_, size in zip(ids, sizes):
        part = 0
        while True:
            take = min(int(size), capacity)
            no, at = p.put(take)
            out.append((id_, part, f"{shard}-{no}", take, at))
            size -= take
            part += 1
            if size <= 0:
                break
    return pd.DataFrame(out, columns=["id", "part", "container_id", "n_chars", "offset"])


def containers(items: DataFrame, capacity: int, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """id, part, container_id, n_chars, offset: where each distinct id's content lies.

    Sizes are code points. A null or empty content has size 0 and lies in some container; rows with one id count once,
    with their longest content; the null id is an id like others. Only ids and sizes are shuffled. Arrival order within
    a shard is the order of the id's hash, so the result does not depend on partitioning.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    shards = max(1, round(items.count() / items_per_shard))
    h = F.xxhash64(F.coalesce("id", F.lit("")))
    sized = items.groupBy(F.col("id").cast("string").alias("id")).agg(F.max(F.coalesce(F.length("content"), F.lit(0))).alias("n"))
    sized = sized.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int")).withColumn("ord", h)

    def pack(key, rows):
        rows = rows.sort_values(["ord", "id"], na_position="first")
        return pack_shard(rows["id"], rows["n"], int(key[0]), capacity)

    return sized.groupBy("shard").applyInPandas(pack, SCHEMA)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_items, n_chars, fill (share of the containers' space that is used)."""
    per = packed.groupBy("container_id").agg(F.sum("n_chars").alias("used"), F.count_if(F.col("part") == 0).alias("items"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_chars"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.max("used").alias("fullest"),
    )
