"""An ordered fold per key that never puts one key's whole history into one task.

The history of a key is cut into chunks of at most a given number of rows. (1) every chunk is
summarised on its own as a function of the state it is entered with, (2) the small summaries of a key
are walked in order to find each chunk's entry state, (3) every chunk is replayed from that state.
Steps 1 and 3 are spread over (key, chunk); step 2 handles one small row per chunk and streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from linkguard.shared import staged

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 14


def count_chunks(df: DataFrame, keys: list[str], order: list[str], bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``_chunk``, which grows with ``order`` and holds at most ``2 ** bits`` rows, of a key or of all.

    Rows are dealt out by ranges of (key, order), so a hot key covers many partitions, and a partition's rows are cut every
    ``2 ** bits`` of them: the running number starts anew at a multiple of that in each partition. Ranges rest on samples
    that a second run need not draw alike, so the chunks are written to the shared folder once.
    """
    by = [*keys, *order]
    cut = F.shiftright(F.monotonically_increasing_id(), bits)
    return staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_chunk", cut), "chunks")


def chunked_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | int, *, summary_schema: str,
                 state_schema: str, out_schema: str, summarize: Callable, step: Callable,
                 initial, replay: Callable) -> DataFrame:
    """``chunk`` is the power of two of a chunk's rows, or a Column that grows with ``order``.

    ``summarize(group) -> tuple`` (columns of ``summary_schema``), ``step(state, summary_row) ->
    state`` and ``replay(group, state) -> dict of arrays`` (columns of ``out_schema``) run in Python
    on one chunk at a time, a dict of arrays; a state is one value of ``state_schema`` type.
    """
    part = count_chunks(df, keys, order, chunk) if isinstance(chunk, int) else df.withColumn("_chunk", chunk)
    by = [*keys, "_chunk"]
    types = dict(part.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        """Complete groups of a sorted stream of batches, as column name -> array slice."""
        rest: list[pd.DataFrame] = []

        def key(frame, i):
            return [frame[c].iloc[i] for c in by]

        for b in batches:
            if not len(b):
                continue
            if rest and key(rest[-1], -1) == key(b, 0) == key(b, -1):  # sorted, so one group all through
                rest.append(b)
                continue
            b = pd.concat([*rest, b], ignore_index=True) if rest else b
            cols = {c: b[c].to_numpy() for c in b.columns}
            new = np.zeros(len(b) - 1, dtype=bool)
            for c in by:
                new |= (cols[c][1:] != cols[c][:-1]).astype(bool)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            for i, j in zip(starts[:-1], starts[1:]):
                yield {c: v[i:j] for c, v in cols.items()}
            rest = [b.iloc[starts[-1]:]]
        if rest:
            last = pd.concat(rest, ignore_index=True)
            yield {c: last[c].to_numpy() for c in last.columns}

    def run_summaries(batches):
        rows = []
        for g in groups(batches):
            rows.append((*[g[c][0] for c in by], *summarize(g)))
            if len(rows) >= 10000:
                yield pd.DataFrame(rows, columns=[*by, *names])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[*by, *names])

    def run_walk(batches):
        key, state = None, initial
        for b in batches:
            entry = []
            for row in b.itertuples(index=False):
                k = tuple(row[:len(keys)])
                if k != key:
                    key, state = k, initial
                entry.append(state)
                state = step(state, row[len(by):])
            out = b[by].copy()
            out["_state"] = entry
            yield out

    def run_replay(batches):
        out, n = {c: [] for c in out_names}, 0

        def frame():
            return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})
        for g in groups(batches):
            got = replay(g, g["_state"][0])
            for c in out_names:
                out[c].append(got[c])
            n += len(got[out_names[0]])
            if n >= 10000:
                yield frame()
                out, n = {c: [] for c in out_names}, 0
        if n:
            yield frame()

    out_names = [c.split()[0] for c in out_schema.split(", ")]
    names = [c.split()[0] for c in summary_schema.split(", ")]
    sorted_parts = part.repartition(*by).sortWithinPartitions(*by, *order)
    summaries = sorted_parts.mapInPandas(run_summaries,
                                         f"{key_ddl}, _chunk bigint, {summary_schema}")
    entries = summaries.repartition(*keys).sortWithinPartitions(*by).mapInPandas(
        run_walk, f"{key_ddl}, _chunk bigint, _state {state_schema}")
    joined = part.join(entries, by).repartition(*by).sortWithinPartitions(*by, *order)
    return joined.mapInPandas(run_replay, out_schema)


def time_chunk(ts_us: str, seconds: int):
    """Chunk number of a microsecond column."""
    return F.floor(F.col(ts_us) / F.lit(seconds * 1_000_000)).cast("bigint")
