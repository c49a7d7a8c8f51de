"""Splitting oversized items at natural boundaries.

A text is cut into tokens by the pre-tokeniser of `bpe` (class arrays, no regular expression), and further at line
starts. The tokens' sizes - code points, or ids of the public tokenizer - are summed up to prefix sums, over which line
starts and structural boundaries are sorted arrays. A cut is found by binary search: the last structural boundary under
the limit (a line after a blank one, or an unindented line that opens something), if it fills at least half of the
limit; else the last line start; else the last token. Tokens that are larger than the limit alone are cut hard before.
The next piece begins the given number of lines before the cut, or fewer where the limit would leave no room for
anything new.

Lines end with LF, CRLF or CR.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bpe import DEFAULT_VOCABULARY, class_table, merger, token_starts, vocabulary

_EOL = re.compile(r"\r\n|\n|\r")
_STRUCT = re.compile(r"[^\s)}\]>,;:|&+*/.=-]")
_WIDE = re.compile("[\u0300-\u036f\u200d\ufe00-\ufe0f\U0001f3fb-\U0001f3ff]")

SCHEMA = "id string, content_hash bigint, piece_no int, n_pieces int, start_line bigint, end_line bigint, start_char int, end_char int, shared_lines int, text string"


def line_starts(text: str) -> list[int]:
    """Offsets at which lines begin, and the length of the text as the last entry. A final line end opens no line."""
    out = [0, *(m.end() for m in _EOL.finditer(text))]
    if out[-1] != len(text):
        out.append(len(text))
    return out if len(out) > 1 else [0, len(text)]


def _structural(text: str, starts: list[int]) -> list[int]:
    out = []
    for i in range(1, len(starts) - 1):
        a, before = starts[i], text[starts[i - 1] : starts[i]]
        if not before.strip() or _STRUCT.match(text, a):
            out.append(a)
    return out


_classes: list[np.ndarray] = []


def token_table(text: str, starts: list[int], limit: int, sizes: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of tokens and the end, prefix sums of their sizes). A blank between words belongs to the word before it.
    Tokens over the limit are cut: at the limit, one or more code points earlier where that would part a combined
    character; where sizes are not code points, into pieces that cannot exceed it, as a code point has at most 4 ids."""
    if not _classes:
        _classes.append(class_table())
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = token_starts(cp, np.zeros(1, dtype=np.int64), _classes[0])
    begins = np.zeros(len(cp) + 2, dtype=bool)
    begins[at + ((cp[at] == 0x20) & (at + 1 < len(cp)))] = True
    begins[starts[:-1]] = True
    begins[0] = begins[len(cp)] = True
    off = np.flatnonzero(begins)
    size = np.asarray(sizes([text[a:b] for a, b in zip(off.tolist(), off[1:].tolist())])) if sizes else np.diff(off)
    if size.max() > limit:
        new, new_size = [], []
        for a, b, n in zip(off.tolist(), off[1:].tolist(), size.tolist()):
            step = limit if sizes is None else max(1, limit // 4)
            while n > limit:
                cut = a + step
                while sizes is None and cut > a + 1 and _WIDE.match(text, cut):
                    cut -= 1
                cut = cut if cut > a + 1 else a + step
                if cut >= b:
                    break
                new.append(a)
                new_size.append(cut - a if sizes is None else sizes([text[a:cut]])[0])
                a = cut
                n = b - a if sizes is None else sizes([text[a:b]])[0]
            new.append(a)
            new_size.append(n)
        off, size = np.asarray([*new, len(text)]), np.asarray(new_size)
    return off, np.concatenate([[0], np.cumsum(size)])


def split_offsets(text: str, limit: int, overlap: int, sizes: Callable | None = None, lines: list[int] | None = None) -> list[tuple[int, int, int]]:
    """[(start, end, shared lines)] of the pieces in code points; a text within the limit is one piece, the empty text too.

    `sizes` gives the sizes of a list of tokens in the limit's unit; without it sizes are code points."""
    if limit < 1 or overlap < 0 or sizes and limit < 4:
        raise ValueError("limit must be positive (4 at least for token ids) and overlap not negative")
    if not text or sizes is None and len(text) <= limit:
        return [(0, len(text), 0)]
    lines = lines or line_starts(text)
    off, total = token_table(text, lines, limit, sizes)
    end = len(off) - 1
    starts = np.searchsorted(off, lines).tolist()
    structural = np.searchsorted(off, _structural(text, lines)).tolist()
    last = lambda bound: int(np.searchsorted(total, bound, side="right")) - 1
    out, a, done, shared = [], 0, 0, 0
    while True:
        if total[end] - total[a] <= limit:
            out.append((int(off[a]), int(off[end]), shared))
            return out
        reach = last(total[a] + limit)
        cut = 0
        i = bisect_right(structural, reach) - 1
        if i >= 0 and structural[i] > done and total[structural[i]] >= total[a] + limit // 2:
            cut = structural[i]
        if not cut:
            i = bisect_right(starts, reach) - 1
            if starts[i] > done:
                cut = starts[i]
        if not cut:
            a, shared = done, 0
            cut = last(total[a] + limit)
        out.append((int(off[a]), int(off[cut]), shared))
        first_of_piece, done = a, cut
        line = bisect_right(starts, cut) - 1  # the line that holds the cut, or begins there
        inside = starts[line] != cut
        unit = starts[line + 1] if line + 1 < len(starts) else end  # the least that the next piece should add
        a, shared = cut, 0
        for j in range(max(line - overlap + inside, 0), line + inside):
            room = total[unit] - total[starts[j]] <= limit if total[unit] - total[cut] <= limit else total[cut] - total[starts[j]] <= limit // 2
            if room and starts[j] > first_of_piece:
                a, shared = starts[j], line - j + inside
                break


def split_rows(rows: pd.DataFrame, limit: int, overlap: int, with_text: bool, sizes: Callable | None = None) -> pd.DataFrame:
    out = []
    for id_, text, first, h in zip(rows["id"], rows["content"], rows["start_line"], rows["content_hash"]):
        base = 1 if pd.isna(first) else int(first)
        starts = line_starts(text)
        pieces = split_offsets(text, limit, overlap, sizes, starts)
        for k, (a, b, shared) in enumerate(pieces):
            la, lb = bisect_right(starts, a) - 1, max(bisect_left(starts, b) - 1, 0)
            out.append((id_, h, k, len(pieces), base + la, base + lb, a, b, shared, text[a:b] if with_text else None))
    return pd.DataFrame(out, columns=["id", "content_hash", "piece_no", "n_pieces", "start_line", "end_line", "start_char", "end_char", "shared_lines", "text"])


def pieces(items: DataFrame, limit: int, overlap: int, with_text: bool = True, unit: str = "characters", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Pieces of every item with non-null content: id, content_hash (XXH64 of the item's content), piece_no (from 0),
    n_pieces, its lines, its code points [start_char, end_char), the lines shared with the piece before, and its text
    (null if not `with_text`). The limit counts characters (code points) or, with unit 'tokens', ids of the vocabulary.

    Items that are surely within the limit never leave the JVM; only others go through Arrow. Nothing is shuffled. A row
    written twice gives its pieces twice; `distinct_pieces` keeps one of them. Null contents have no pieces, an empty
    content is one empty piece, a null start_line counts from 1. Other columns are not carried.
    """
    if unit not in ("characters", "tokens"):
        raise ValueError(f"unknown unit {unit!r}")
    data = vocabulary(path) if unit == "tokens" else None
    it = items.where(F.col("content").isNotNull()).select(
        F.col("id").cast("string").alias("id"), "content", F.col("start_line").cast("bigint").alias("start_line"), F.xxhash64("content").alias("content_hash")
    )
    first = F.coalesce("start_line", F.lit(1).cast("bigint"))
    eols = F.regexp_count("content", F.lit(r"\r\n|\n|\r")) - F.when(F.col("content").rlike(r"[\r\n]\z"), 1).otherwise(0)
    size = F.length("content") if unit == "characters" else F.octet_length("content")
    whole = it.where(size <= limit).select(
        "id", "content_hash", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), first.alias("start_line"), (first + eols).alias("end_line"),
        F.lit(0).alias("start_char"), F.length("content").alias("end_char"), F.lit(0).alias("shared_lines"),
        (F.col("content") if with_text else F.lit(None).cast("string")).alias("text"),
    )

    def cut(batches):
        sizes = None
        if data is not None:
            m = merger(data)
            sizes = lambda tokens: [len(m.piece(t)) for t in tokens]
        for b in batches:
            yield split_rows(b, limit, overlap, with_text, sizes)

    return whole.unionByName(it.where(size > limit).mapInPandas(cut, SCHEMA))


def distinct_pieces(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces by their offsets and lines, those of rows written twice once; different contents under one id are told apart
    by content_hash. Only these small rows are shuffled, no text: a piece's text is its stretch of the item's content."""
    return pieces(items, limit, overlap, with_text=False).drop("text").distinct()
