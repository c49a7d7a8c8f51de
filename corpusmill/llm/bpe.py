"""Encoding texts with a public byte-level BPE vocabulary, without a regular expression.

Pre-tokenisation works on arrays: the texts of a batch are one array of code points, a table maps these to classes
(letter, number, other, white space, blank), and token starts follow from the class of a code point and of its
neighbours. As an automaton, each class's transition function sends every state to the same state, and the run a code
point belongs to is the composition of the functions before it; since composing such functions keeps the last one,
the associative scan over them is a shift. The two exceptions are resolved on the scanned runs: the last white space
before a word belongs to the word or stands alone, and an apostrophe with a short suffix is a token of its own.

The slices are looked up in a cache of merged pieces; a piece that is not there is merged pair by pair by rank.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Bounds of one worker's cache and of the code points that are worked on at once.
CACHE_PIECES, CACHE_CHARS, BATCH_CHARS = 400_000, 64, 2_000_000

LETTER, NUMBER, OTHER, SPACE, BLANK, EDGE = 1, 2, 3, 4, 5, 0
# fixed values: code points with the property White_Space
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """Class of every code point, from the general categories of the Unicode data that Python ships."""
    import unicodedata

    t = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE_SPACE] = SPACE
    t[0x20] = BLANK
    return t


def token_starts(cp: np.ndarray, begins: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Offsets of token starts in the code points `cp`, whose texts begin at `begins` (empty texts left out)."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = table[cp]
    prev, nxt = np.empty_like(cls), np.empty_like(cls)
    prev[1:], nxt[:-1] = cls[:-1], cls[1:]
    prev[begins] = EDGE
    nxt[-1] = EDGE
    nxt[begins[begins > 0] - 1] = EDGE
    white, white_before = cls >= SPACE, prev >= SPACE
    start = np.where(white, ~white_before | ((nxt < SPACE) & (nxt != EDGE)), (cls != prev) & (prev != BLANK))
    apostrophe = np.flatnonzero((cp == 0x27) & start & (nxt == LETTER) & (prev != OTHER))
    if len(apostrophe):
        first = cp[apostrophe + 1]
        inside = np.zeros(n + 3, dtype=bool)
        inside[: n - 1] = nxt[:-1] != EDGE  # a next code point in the same text
        second = np.where(inside[apostrophe + 1], cp[np.minimum(apostrophe + 2, n - 1)], 0)
        one = np.isin(first, [ord(x) for x in "stmd"])
        two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        length = np.where(one, 1, np.where(two, 2, 0))
        at, length = apostrophe[length > 0], length[length > 0]
        start[at + 1] = False
        after = at + 1 + length
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Merger:
    """Ranks and the cache of merged pieces."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.table = class_table()
        self._back: dict[int, bytes] = {}

    def back(self) -> dict[int, bytes]:
        """Bytes of each id."""
        if not self._back:
            self._back = {i: b for b, i in self.ranks.items()}
        return self._back

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece: the adjacent pair of least rank, the leftmost first, is merged until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i is piece[i:end[i]]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= e or end[end[i]] != e:
                continue  # one of its parts was merged with another
            j = end[i]
            alive[j] = False
            end[i] = e
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def piece(self, s: str) -> tuple[int, ...]:
        got = self.cache.get(s)
        if got is None:
            got = self.merge(s.encode())
            if len(s) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[s] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text, code point offset in its text of each id's
        piece): the offsets let a slice of the ids be traced to the text without decoding."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        begins = (ends - lengths)[lengths > 0]
        starts = token_starts(cp, begins, self.table)
        bounds = np.append(starts, len(cp)).tolist()
        piece, cache = self.piece, self.cache
        ids = [cache.get(s) or piece(s) for s in (joined[a:b] for a, b in zip(bounds, bounds[1:]))]
        per_piece = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(per_piece.sum()))
        total = np.concatenate([[0], np.cumsum(per_piece)])
        upto = total[np.searchsorted(starts, ends)]
        counts = np.diff(np.concatenate([[0], upto]))
        text_of = np.searchsorted(ends, starts, side="right")
        return flat, counts, np.repeat(starts - (ends - lengths)[text_of], per_piece)


_mergers: dict[int, Merger] = {}


def merger(data: bytes) -> Merger:
    """One per worker process and vocabulary."""
    key = hash(data)
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(data)
    return _mergers[key]


def vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The file's bytes (of a fixed size, under a megabyte for the public ones), shipped to the executors in the task
    closure, so that these need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


def _slices(texts: list[str]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode_column(data: bytes, texts: pa.Array, offsets: bool = False) -> list[pa.Array]:
    m = merger(data)
    ids, at, lens = [], [], []
    for part in _slices(["" if t is None else t for t in texts.to_pylist()]):
        flat, counts, off = m.encode(part)
        ids.append(flat)
        lens.append(counts)
        at.append(off)
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lens) if lens else [])]).astype(np.int32))
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    out = [pa.ListArray.from_arrays(bounds, pa.array(flat, type=pa.int32()))]
    if offsets:
        out.append(pa.ListArray.from_arrays(bounds, pa.array((np.concatenate(at) if at else np.zeros(0)).astype(np.int32))))
    return out


def encode(docs: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """key, ids (and offsets): token ids of each row's text, without special tokens; their strings are plain text.

    Null and empty texts have the empty list. No row is dropped or shuffled; repeated rows stay repeated.
    """
    data = vocabulary(path)
    kept = spread(docs.select(F.col(key).alias(key), F.col(text).alias("_text")))
    kind = dict(kept.dtypes)[key]
    schema = f"`{key}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")

    def run(batches):
        for b in batches:
            cols = encode_column(data, b.column(1), offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "ids", *["offsets"] * offsets])

    return kept.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, keep: list[str], text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`keep` and n_tokens; the ids do not leave the worker."""
    data = vocabulary(path)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", n_tokens bigint"

    def run(batches):
        m = merger(data)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(b.num_columns - 1).to_pylist()]
            counts = [m.encode(part)[1] for part in _slices(texts)]
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return kept.mapInArrow(run, schema)


def truncated(m: Merger, text: str, most: int) -> str:
    """The text of its first most - 1 ids; one is left for a special token."""
    flat = m.encode([text])[0].tolist()[: max(most - 1, 0)]
    back = m.back()
    return b"".join(back[i] for i in flat).decode("utf-8", "replace")


def split_by_tokens(m: Merger, text: str, most: int) -> list[str]:
    """Stretches of at most `most` ids each. A stretch may end within a character, which is then replaced on both sides."""
    if most < 1:
        raise ValueError("stretches need at least one id")
    flat, back = m.encode([text])[0].tolist(), m.back()
    return [b"".join(back[i] for i in flat[a : a + most]).decode("utf-8", "replace") for a in range(0, len(flat), most)]


def decode(rows: DataFrame, key: str, ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key, text: the inverse of `encode` (null texts come back as empty ones)."""
    data = vocabulary(path)
    kept = rows.select(F.col(key).alias(key), F.col(ids).alias("_ids"))

    def run(batches):
        back = {i: b for b, i in merger(data).ranks.items()}
        for b in batches:
            text = [b"".join(map(back.__getitem__, x or ())).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, type=pa.string())], names=[key, "text"])

    return kept.mapInArrow(run, f"`{key}` {dict(kept.dtypes)[key]}, text string")
