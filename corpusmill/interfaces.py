"""What an application plugs in: stored conversations, a cache, cancellation, completions; each with one implementation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any, Protocol

from pyspark.sql import DataFrame, functions as F

from corpusmill.operators import search


class MessageThreads(Protocol):
    def of_session(self, session_id: int, category: str) -> DataFrame: ...

    def by_ids(self, ids: Iterable[int]) -> DataFrame: ...

    def append(self, rows: DataFrame) -> None: ...


class TableThreads:
    """Conversations in a folder of Parquet files with columns id, session_id and call_chain_category."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def of_session(self, session_id: int, category: str) -> DataFrame:
        return self._all().where((F.col("session_id") == session_id) & (F.col("call_chain_category") == category)).orderBy("id")

    def by_ids(self, ids: Iterable[int]) -> DataFrame:
        return self._all().where(F.col("id").isin(list(ids))).orderBy("id")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)


class Cache(Protocol):
    def get(self, key: str) -> Any: ...

    def set(self, key: str, value: Any) -> None: ...


class TimedCache:
    """Values of the driver for a while; the oldest leave first."""

    def __init__(self, most: int = 32, seconds: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock, self._kept = most, seconds, clock, {}

    def get(self, key: str) -> Any:
        value, until = self._kept.get(key, (None, 0.0))
        return value if self.clock() < until else None

    def set(self, key: str, value: Any) -> None:
        self._kept.pop(key, None)
        while len(self._kept) >= self.most:
            self._kept.pop(next(iter(self._kept)))
        self._kept[key] = (value, self.clock() + self.seconds)


class Cancelled(RuntimeError):
    """Work that was asked to stop."""


class Cancellation:
    """Asked before each step of a loop over batches or stages; `cancel` makes the next `check` raise and stops the session's
    jobs of the given group."""

    def __init__(self, spark=None, group: str | None = None):
        self.spark, self.group, self.stopped = spark, group, False

    def cancel(self) -> None:
        self.stopped = True
        if self.spark is not None and self.group:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        if self.stopped:
            raise Cancelled("cancelled")


class AutoComplete:
    """Completions of a keyword in names and paths: keyword search, then what the caller may see."""

    def __init__(self, rows: DataFrame, key: str, fields: list[str], index):
        self.rows, self.key, self.fields, self.index = rows, key, fields, index

    def search(self, keyword: str, allowed: DataFrame, on: list[str], limit: int = 50) -> DataFrame:
        if not keyword:
            raise ValueError("a keyword is needed")
        scored = search.keyword_search(self.rows, self.key, self.fields, self.index, [keyword]).drop("query")
        return search.autocomplete(scored, self.key, self.rows, allowed, on, limit)
