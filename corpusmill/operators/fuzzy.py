"""Fuzzy path search by the ratio of matching blocks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def ratio(a: str, b: str) -> int:
    """0..100: twice the matching characters over all characters, rounded."""
    return round(100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def fuzzy_paths(paths: DataFrame, key: str, path: str, term: str, least: int = 70) -> DataFrame:
    """key, best of the paths with a part whose ratio to the term is at least `least`. Distinct parts are few against
    paths, are compared once each, and only the similar ones are joined back."""
    parts = paths.select(key, F.explode(F.split(F.lower(path), "/")).alias("part")).where("part <> ''")

    @F.pandas_udf("int")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda p: ratio(term.lower(), p))

    near = parts.select("part").distinct().withColumn("score", score("part")).where(F.col("score") >= least)
    return parts.join(near, "part").groupBy(key).agg(F.max("score").alias("best"))
