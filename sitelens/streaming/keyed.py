"""Admission and window counts as keyed state: event time over any number of batches.

Keys are dealt into hash buckets, and a bucket has one state.  A request waits there until the watermark has passed it, so rows may
come late by the delay of the watermark and are still taken in the order of their time.  Then it is
decided as the batch operator decides, and only the admissions that still count stay,
at most ``limit`` for each key.  A timer wakes a bucket when its next request is due, and once
more when its last admission no longer counts; then its state is gone.

Sliding windows are counted from slices that no window cuts: a row is one row of state, not one
for each of its windows, and the windows of a slice are made when they are final.
"""

import math
import pickle
from collections import deque
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import micros

DECISIONS = "key string, at bigint, id bigint, admitted boolean"
COUNTS = "start bigint, end bigint, key string, n bigint"
#: Hash buckets of keys, each with one state.
BUCKETS = 256
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _due(at: int) -> int:
    """The millisecond by which an instant in microseconds has passed."""
    return -(-at // 1_000)


def _decisions(rows: list[tuple[str, int, int]], admitted: list[bool]) -> pd.DataFrame:
    # Plain strings: pandas' own string type is not taken by Spark's serializer.
    return pd.DataFrame(
        {
            "key": pd.Series([r[0] for r in rows], dtype=object),
            "at": pd.Series([r[1] for r in rows], dtype="int64"),
            "id": pd.Series([r[2] for r in rows], dtype="int64"),
            "admitted": pd.Series(admitted, dtype=bool),
        }
    )


def _packed(rows: list[tuple]) -> tuple[bytes]:
    """Rows as one value of a list state, which is far slower row by row."""
    return (pickle.dumps(rows),)


def _rows(state) -> list[tuple]:
    return [row for value in state.get() for row in pickle.loads(value[0])]


class Admission(StatefulProcessor):
    """State of the keys of one bucket: a call to the state costs far more than a row in it."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.taken = handle.getListState("taken", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [r for pdf in rows for r in zip(pdf["key"].tolist(), pdf["at"].tolist(), pdf["id"].tolist())]
        self.waiting.appendValue(_packed(arrived))
        self.handle.registerTimer(_due(min(r[1] for r in arrived)))
        yield _decisions([], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        taken = {}
        for k, at in sorted(_rows(self.taken)):
            taken.setdefault(k, deque()).append(at)
        ready, rest = [], []
        for r in _rows(self.waiting):
            (ready if r[1] <= passed else rest).append(r)
        ready.sort(key=itemgetter(1, 2))
        decided = []
        for k, at, _ in ready:
            mine = taken.setdefault(k, deque())
            while mine and mine[0] <= at - self.window:
                mine.popleft()
            decided.append(len(mine) < self.limit)
            if decided[-1]:
                mine.append(at)
        live = [(k, at) for k, mine in taken.items() for at in mine if at > passed - self.window]
        if rest:
            self.waiting.put([_packed(rest)])
            self.handle.registerTimer(_due(min(r[1] for r in rest)))
        else:
            self.waiting.clear()
        if live:
            self.taken.put([_packed(live)])
            self.handle.registerTimer(_due(max(at for _, at in live) + self.window))
        else:
            self.taken.clear()
        yield _decisions(ready, decided)

    def close(self) -> None:
        pass


def admissions(
    requests: DataFrame, limit: int, window_seconds: int, late: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """``DECISIONS`` for a stream of requests (key, created_at, id), each once the watermark
    (the newest time less ``late``) has passed it.

    Rows that come later than that are dropped by the watermark; rows without key or time are
    not decided.  A limit of one gives the first sighting of a key in each window.  The waiting
    rows of a bucket of keys are in memory at once: more ``buckets`` for larger streams, and
    the same number for as long as a checkpoint is used.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp"))
    timed = timed.filter("key IS NOT NULL AND created_at IS NOT NULL").withWatermark("created_at", late)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    keyed = timed.select(bucket, F.col("key").cast("string").alias("key"), "created_at", micros(F.col("created_at")).alias("at"), F.col("id").cast("bigint").alias("id"))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Admission(limit, window_seconds * 1_000_000),
        outputStructType=DECISIONS, outputMode="Append", timeMode="EventTime",
    )


def _summed(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return frame.groupby(by, dropna=False, sort=False, as_index=False)["n"].sum()


class WindowCounts(StatefulProcessor):
    """Rows per key and window, for the keys of one bucket.

    ``window`` and ``slide`` are microseconds.  The state holds the rows per key and slice while a
    window of the slice is not final, and up to which end windows are written.  A timer wakes the
    bucket whenever the watermark has moved.
    """

    #: Rows of one frame that is given to Spark, and of frames that are added up.
    FRAME = 100_000

    def __init__(self, window: int, slide: int):
        self.window, self.slide, self.slice = window, slide, math.gcd(window, slide)
        self.frame = self.FRAME

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.written = handle.getValueState("written", "until bigint")

    def _until(self) -> int:
        return self.written.get()[0] if self.written.exists() else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, size, most = [], 0, self.frame
        for pdf in rows:
            slices = pd.DataFrame({"key": pdf["key"].astype(object), "at": pdf["at"] // self.slice * self.slice, "n": 1})
            parts.append(_summed(slices, ["key", "at"]))
            size += len(parts[-1])
            if size > most:
                # Many rows of a key in a slice are never held at once.
                parts = [_summed(pd.concat(parts), ["key", "at"])]
                size, most = len(parts[0]), self.frame + 2 * len(parts[0])
        arrived = _summed(pd.concat(parts), ["key", "at"])
        # Rows that are too late for all of their windows.
        arrived = arrived[arrived["at"] // self.slide * self.slide + self.window > self._until()]
        if len(arrived):
            self.open.appendValue((pickle.dumps([arrived[c].to_numpy() for c in ("key", "at", "n")]),))
        # The watermark of this batch may have passed some of their windows already.
        self.handle.registerTimer(max(1, timerValues.getCurrentWatermarkInMs() - 1))
        yield self._frame(arrived[:0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        until, now = self._until(), passed * 1_000
        # Once more when the watermark has moved.
        self.handle.registerTimer(passed + 1)
        if now <= until:
            yield self._frame(pd.DataFrame({"key": [], "start": [], "n": []}))
            return
        self.written.update((now,))
        parts = [pd.DataFrame(dict(zip(("key", "at", "n"), pickle.loads(value[0])))) for value in self.open.get()]
        if not parts:
            yield self._frame(pd.DataFrame({"key": [], "start": [], "n": []}))
            return
        slices = pd.concat(parts)
        if len(parts) > 1:
            slices = _summed(slices, ["key", "at"])
        at, n = slices["at"].to_numpy(), slices["n"].to_numpy()
        code, names = pd.factorize(slices["key"], use_na_sentinel=False)
        names = np.array([k if isinstance(k, str) else None for k in names], dtype=object)
        last = at // self.slide * self.slide
        final = []
        for back in range(-(-self.window // self.slide)):
            start = last - back * self.slide
            end = start + self.window
            due = (end > at) & (end > until) & (end <= now)
            final.append(pd.DataFrame({"code": code[due], "start": start[due], "n": n[due]}))
        counts = _summed(pd.concat(final), ["code", "start"])
        rest = last + self.window > now
        if rest.any():
            self.open.put([(pickle.dumps([names[code[rest]], at[rest], n[rest]]),)])
        else:
            self.open.clear()
        for i in range(0, max(1, len(counts)), self.frame):
            some = counts[i : i + self.frame]
            yield self._frame(some.assign(key=names[some["code"].to_numpy()]))

    def _frame(self, counts: pd.DataFrame) -> pd.DataFrame:
        start = counts["start"].to_numpy("int64") if "start" in counts else np.zeros(0, "int64")
        return pd.DataFrame(
            {
                "start": start,
                "end": start + self.window,
                "key": pd.Series(list(counts["key"]), dtype=object),
                "n": counts["n"].to_numpy("int64"),
            }
        )

    def close(self) -> None:
        pass


def window_counts(
    rows: DataFrame, window: str, slide: str, late: str, buckets: int = BUCKETS
) -> DataFrame:
    """``COUNTS`` for a stream of rows (key, created_at): rows per key in sliding windows, each
    written once, when the watermark (the newest time less ``late``) has passed its end.

    A row that comes later than ``late`` counts in those of its windows that are not written yet for
    its bucket.  Rows without a time are not counted, rows without a key are counted
    as one key.  The rows of a key go to one task.  The open slices of a bucket of keys are in memory at once, and so are the windows made
    of them: more ``buckets`` for larger streams, and the same number for as long as a checkpoint is used.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.filter("created_at IS NOT NULL").withWatermark("created_at", late)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    # Without the column of the watermark: Spark would drop a late row whole, with the windows that are open.
    keyed = timed.select(bucket, F.col("key").cast("string").alias("key"), micros(F.col("created_at")).alias("at"))
    size, step = (pd.Timedelta(text) // pd.Timedelta("1us") for text in (window, slide))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=WindowCounts(size, step),
        outputStructType=COUNTS, outputMode="Append", timeMode="EventTime",
    )
