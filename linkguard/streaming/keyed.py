"""Keyed state for streams: processors that keep one small value per key, or bucket of keys, in the state store.

The store is RocksDB, so state lies on disk and in the checkpoint, and a micro-batch touches only the
keys that it brings. Rows of a key come as an iterator of frames. Timers run on event time, so a key
whose value can no longer matter is forgotten once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that throttled keys are dealt out to. A stream's folder holds its state by bucket, so a running stream keeps the number.
BUCKETS = 512
#: Before any time in microseconds.
NEVER = -(1 << 63)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstRow(StatefulProcessor):
    """The least row, by ``order`` columns, of the micro-batch that brings a key first."""

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:  # the iterator has to be read to its end
                pass
            return
        best = None
        for frame in rows:
            low = frame.sort_values(self.order).head(1)
            best = low if best is None else pd.concat([best, low]).sort_values(self.order).head(1)
        if best is not None:
            self.seen.update((True,))
            yield best[self.columns]

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """Passes a row when ``gap`` microseconds have gone by since its key's last one that passed.

    A group is one key, or with ``buckets`` a bucket of keys that are told apart by the column
    ``event_key``: calls to the state store cost far more than rows, and there are as many as there are
    groups, not keys. The state is the last time, or a small table of keys and last times.
    A batch's rows are taken by key, time, then id; rows that the state already rules out are dropped
    frame by frame, and of equal times of a key only the least id is held. A row that comes late passes
    only behind the last one that passed. A key is forgotten when the watermark is ``ttl`` past its last
    row: a row that would then still be let in by the watermark is further away than any gap, so
    forgetting never changes a result. A timer does so for a group that gets no more rows.
    """

    #: Rows that wait at least before they are merged with those held.
    WAITING = 50_000

    def __init__(self, columns: list[str], id_col: str, gap: int, ttl: int, buckets: bool = False):
        self.columns, self.id_col, self.gap, self.ttl, self.buckets = columns, id_col, gap, max(gap, ttl), buckets
        self.key = ["event_key"] if buckets else []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "held binary" if self.buckets else "us long")

    def _load(self) -> dict[str | None, int]:
        """Last times by key."""
        if not self.last.exists():
            return {}
        (value,) = self.last.get()
        if not self.buckets:
            return {None: value}
        t = pa.ipc.open_stream(bytes(value)).read_all()
        return dict(zip(t.column("key").to_pylist(), t.column("us").to_pylist()))

    def _store(self, last: dict[str | None, int]) -> None:
        if not self.buckets:
            self.last.update((last[None],))
            return
        t = pa.table({"key": pa.array(last.keys(), pa.string()), "us": pa.array(last.values(), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        self.last.update((sink.getvalue().to_pybytes(),))

    def _keys(self, frame: pd.DataFrame) -> list:
        return frame["event_key"].tolist() if self.buckets else [None] * len(frame)

    def _due(self, last: int) -> int:
        """The watermark in milliseconds at which a key is forgotten."""
        return (last + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self._load()
        held: pd.DataFrame | None = None
        waiting, n = [], 0

        def merged() -> pd.DataFrame:
            frame = pd.concat([*([held] if held is not None else []), *waiting])
            return frame.sort_values([*self.key, "event_us", self.id_col]).drop_duplicates([*self.key, "event_us"])

        for frame in rows:
            if last:
                free = np.array([last[k] + self.gap if k in last else NEVER for k in self._keys(frame)], np.int64)
                frame = frame[frame["event_us"].to_numpy() >= free]
            if len(frame):
                waiting.append(frame)
                n += len(frame)
            if n > max(self.WAITING, 0 if held is None else len(held)):  # a row is sorted a few times, however many frames come
                held, waiting, n = merged(), [], 0
        if waiting:
            held = merged()
        if held is None:
            return
        passed, now, free = [], (), NEVER
        for i, (k, us) in enumerate(zip(self._keys(held), held["event_us"].tolist())):
            if (k,) != now:
                now, free = (k,), last[k] + self.gap if k in last else NEVER
            if us >= free:
                passed.append(i)
                last[k], free = us, us + self.gap
        if self.buckets:
            mark = timerValues.getCurrentWatermarkInMs()
            last = {k: us for k, us in last.items() if self._due(us) > mark}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last:
            self._store(last)
            self.handle.registerTimer(self._due(max(last.values())))
        else:
            self.last.clear()
        yield held.iloc[passed][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append-mode stream with the first row of each key. The state is one flag per key and is kept."""
    use_rocksdb(stream.sparkSession)
    columns = stream.columns
    return stream.groupBy(key).transformWithStateInPandas(
        FirstRow(columns, order), stream.schema, "append", "none")


def throttled(stream: DataFrame, keys: list[str], id_col: str, seconds: int, ttl_seconds: int,
              buckets: int | None = None) -> DataFrame:
    """Append-mode stream of the rows that pass; the stream needs a watermark on ``ts``. Keys are dealt out to ``buckets``."""
    use_rocksdb(stream.sparkSession)
    timed = stream.where(F.col("ts").isNotNull()).withColumn("event_us", F.unix_micros("ts"))
    # the whole key as text: null fields are left out, so that null and '' differ
    timed = timed.withColumn("event_key", F.to_json(F.struct(*keys)))
    timed = timed.withColumn("event_bucket", F.pmod(F.xxhash64("event_key"), F.lit(buckets or BUCKETS)))
    return timed.groupBy("event_bucket").transformWithStateInPandas(
        Throttle(stream.columns, id_col, seconds * 1_000_000, ttl_seconds * 1_000_000, True), stream.schema, "append", "eventTime")
