"""Folding ordered event streams: blocks, batches of deltas, usage, cancellation, tags; batch plans and stateful twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def fold_blocks(events: DataFrame, stream: str, order: list[str], start: Column, delta: Column, end: Column, value: str) -> DataFrame:
    """stream, block, n_deltas, total: one row per block that was started and ended. A new start drops the open block;
    deltas and ends without an open block are ignored; an unended block is lost."""
    w = Window.partitionBy(stream).orderBy(*order)
    e = events.withColumn("_s", start).withColumn("_d", delta).withColumn("_e", end).withColumn("block", F.sum(F.col("_s").cast("int")).over(w)).where(F.col("block") > 0)
    b = Window.partitionBy(stream, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_over", F.coalesce(F.max(F.col("_e").cast("int")).over(b), F.lit(0))).where(F.col("_over") == 0)
    g = e.groupBy(stream, "block").agg(F.count_if("_d").alias("n_deltas"), F.sum(F.when(F.col("_d"), F.col(value))).alias("total"), F.max(F.col("_e").cast("int")).alias("_done"))
    return g.where(F.col("_done") == 1).drop("_done")


def combine_deltas(events: DataFrame, stream: str, order: str, kind: str, text: str, size: int) -> DataFrame:
    """stream, first, kind, n, text: consecutive deltas of one kind in batches of at most `size`, their texts joined; other
    events stay alone. A batch is at most `size` rows, so nothing unbounded is collected."""
    w = Window.partitionBy(stream).orderBy(order)
    whole = ~F.col(kind).endswith("_delta")
    e = events.withColumn("_new", F.when(whole | (F.coalesce(F.lag(kind).over(w), F.lit("")) != F.col(kind)), 1).otherwise(0))
    e = e.withColumn("_run", F.sum("_new").over(w))
    e = e.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(stream, "_run").orderBy(order)) - 1) / size))
    g = e.groupBy(stream, "_run", "_k").agg(F.min(order).alias("first"), F.first(kind).alias(kind), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"))
    return g.select(stream, "first", kind, "n", F.array_join(F.transform("_t", lambda t: t[text]), "").alias(text))


def until_cancelled(events: DataFrame, stream: str, order: list[str], stop: Column) -> DataFrame:
    """Events before the first stop of their stream."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_stop", F.max(stop.cast("int")).over(w)).where(F.col("_stop") == 0).drop("_stop")


def fold_blocks_stream(events: DataFrame, stream: str, order: str) -> DataFrame:
    """The stateful twin of `fold_blocks` over columns kind ('start', 'delta', 'end') and value. Rows of one stream must
    arrive in order across batches; within a batch they are sorted."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, is_open, n, total = state.get if state.exists else (0, False, 0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for kind, value in zip(rows["kind"], rows["value"]):
            if kind == "start":
                block, is_open, n, total = block + 1, True, 0, 0.0
            elif is_open and kind == "delta":
                n, total = n + 1, total + (0.0 if pd.isna(value) else value)
            elif is_open and kind == "end":
                out.append((key[0], block, n, total))
                is_open = False
        state.update((block, is_open, n, total))
        yield pd.DataFrame(out, columns=[stream, "block", "n_deltas", "total"])

    kind = dict(events.dtypes)[stream]
    return events.groupBy(stream).applyInPandasWithState(
        run, f"`{stream}` {kind}, block bigint, n_deltas bigint, total double", "block bigint, is_open boolean, n bigint, total double", "append", GroupStateTimeout.NoTimeout
    )


class TagParser:
    """Incremental extraction of `<tag>text</tag>` from pieces of text, also where a tag is cut by a piece's end."""

    def __init__(self, tags: set[str]):
        self.tags, self.rest, self.open, self.closed = tags, "", None, 0

    def feed(self, piece: str) -> list[tuple[str | None, str]]:
        """[(tag or None for text outside, text)]; text that may be the begin of a tag is held back."""
        self.rest += piece
        out = []
        while self.rest:
            at = self.rest.find("<")
            if at < 0:
                out.append((self.open, self.rest))
                self.rest = ""
                break
            if at:
                out.append((self.open, self.rest[:at]))
                self.rest = self.rest[at:]
            end = self.rest.find(">")
            wanted = [f"</{self.open}>"] if self.open else [f"<{t}>" for t in self.tags]
            if end >= 0 and self.rest[: end + 1] in wanted:
                self.closed += self.open is not None
                self.open = None if self.open else self.rest[1:end]
                self.rest = self.rest[end + 1 :]
            elif any(w.startswith(self.rest) for w in wanted):
                break
            else:
                out.append((self.open, "<"))
                self.rest = self.rest[1:]
        return out

    def close(self) -> list[tuple[str | None, str]]:
        out, self.rest = ([(self.open, self.rest)] if self.rest else []), ""
        return out


def tagged(text: Column, tag: str) -> Column:
    """All contents of a tag in whole texts: the batch twin of `TagParser`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str | None = None) -> DataFrame:
    """Tumbling counts and sums per kind; with `late`, a watermark lets a stream forget windows. A Spark addition."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
