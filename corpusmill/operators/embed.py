"""Embedding through an injected model; the default is a deterministic feature-hashing model for tests."""

from __future__ import annotations

import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class HashingEmbedder:
    """Words hashed into signed buckets, scaled to length one; an empty text is the zero vector."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % self.dims] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def with_retries(call, tries: int = 5, first_wait: float = 0.2, most_wait: float = 5.0, sleep=time.sleep):
    """`call` with waits that double between failures; the last failure is raised."""

    def run(batch):
        wait = first_wait
        for k in range(tries):
            try:
                return call(batch)
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(wait)
                wait = min(2 * wait, most_wait)

    return run


def embed(rows: DataFrame, key: str, text: str, model=None, batch: int = 256) -> DataFrame:
    """key, vector: one vector per row, aligned by the row itself and not by the order of answers."""
    call = with_retries(model or HashingEmbedder())
    kept = rows.select(F.col(key).alias(key), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            texts = ["" if t is None else t for t in b["_text"]]
            vecs = [v for a in range(0, len(texts), batch) for v in call(texts[a : a + batch])]
            yield pd.DataFrame({key: b[key], "vector": [np.asarray(v, dtype=np.float32) for v in vecs]})

    return kept.mapInPandas(run, f"`{key}` {dict(kept.dtypes)[key]}, vector array<float>")
