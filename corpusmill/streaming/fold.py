"""Folding ordered rows of many streams: one state per stream, in a batch plan and in a stateful one.

The batch fold brings a stream's rows together and in order and walks over them; a task holds the state of one stream at a
time and one Arrow batch, never a stream, so the length of a stream does not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(",")]


def ordered_fold(rows: DataFrame, stream: str, order: list[str], make: Callable, schema: str, number: str | None = None) -> DataFrame:
    """stream (and, if named, a running number from 1 within it) and what the stream's machine gives: `make()` -> machine with feed(row) -> rows and close() -> rows.

    Rows of one stream are fed in the given order (nulls first); a null stream is none, its rows are left out. `schema`
    has the machine's columns, whose types hold no commas. Machines are made in the tasks.
    """
    kept = rows.where(rows[stream].isNotNull()).repartition(stream).sortWithinPartitions(stream, *order)
    columns = [stream, *([number] if number else []), *_names(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine, n = None, None, 0

        def rows_of(found: list[tuple]) -> list[tuple]:
            nonlocal n
            n += len(found)
            return [(key, *([n - len(found) + i] if number else []), *r) for i, r in enumerate(found, 1)]

        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, stream)
                if machine is None or k != key:
                    if machine is not None:
                        out += rows_of(machine.close())
                    key, machine, n = k, make(), 0
                out += rows_of(machine.feed(row))
            yield pd.DataFrame(out, columns=columns)
        if machine is not None:
            yield pd.DataFrame(rows_of(machine.close()), columns=columns)

    numbered = f"`{number}` bigint, " if number else ""
    return kept.mapInPandas(run, f"`{stream}` {dict(kept.dtypes)[stream]}, {numbered}{schema}")


def ordered_fold_stream(rows: DataFrame, stream: str, order: str, make: Callable, schema: str, ends: Callable | None = None) -> DataFrame:
    """The stateful twin: the machine is kept between micro-batches. A stream's rows must arrive in order across batches;
    within one they are sorted. Where `ends(row)` holds the machine is closed and its state removed."""
    names = _names(schema)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(bytes(state.get[0])) if state.exists else make()
        out, over = [], False
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            out += [(key[0], *r) for r in machine.feed(row)]
            if ends is not None and ends(row):
                out += [(key[0], *r) for r in machine.close()]
                over = True
        if over:
            state.remove()
        else:
            state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=[stream, *names])

    return rows.groupBy(stream).applyInPandasWithState(run, f"`{stream}` {dict(rows.dtypes)[stream]}, {schema}", "machine binary", "append", GroupStateTimeout.NoTimeout)
