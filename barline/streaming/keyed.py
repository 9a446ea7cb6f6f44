"""Keyed state with timers: sequential kernels on streams.

``keyed_kernel`` runs the kernels of the batch jobs (``barline.plans.sequential``) with one
typed state per key:

* a value state holds the kernel's numbers, the position of the last released row, how many
  rows were released, the first waiting instant and the one timer that is set;
* a map state holds the rows that wait, in sorted runs of ``RUN_ROWS`` by their first instant.
  A run is one call to the state, however many instants it has. A release merges runs as it
  comes to them, so it holds those that overlap; a micro-batch beyond ``HELD_ROWS`` rows of a
  key goes into runs, so it is never one table.

With ``delay`` rows wait until the watermark has passed their instant. A timer on the event
clock is set for the earliest of them, so a key that receives nothing more still releases
its last rows. Released rows are in the order of all order columns, whatever micro-batches
they came in; a row behind the last released one is late and comes out flagged, with null
outputs. Without ``delay`` all rows of a micro-batch are released with it.

``beat_ms`` adds a heartbeat at every multiple of it on the event clock: a row with the
outputs last emitted and the number of rows so far, as of that instant. ``ttl_ms`` forgets a
key when the watermark is so far behind its last row; heartbeats end there too.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barline.plans.sequential import SequentialKernel
from barline.plans.series import as_list

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW, LATE, BEAT = "row", "late", "beat"
#: Rows of a waiting run, and rows of one key that are in memory before they become runs.
RUN_ROWS, HELD_ROWS = 256, 16_384


def use_typed_state(spark: SparkSession) -> None:
    """Typed states and timers need the state store that has column families."""
    if spark.conf.get(PROVIDER_CONF, "") != PROVIDER:
        spark.conf.set(PROVIDER_CONF, PROVIDER)


class _Machine(StatefulProcessor):
    def __init__(self, kernel: SequentialKernel, ties: list[T.StructField], names: list[str], waits: bool, beat_ms: int | None, ttl_ms: int | None):
        self.kernel, self.ties, self.names = kernel, ties, names
        self.waits, self.beat_ms, self.ttl_ms = waits, beat_ms, ttl_ms
        self.tie_names = [f.name for f in ties]

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = T.ArrayType(T.DoubleType())
        long = T.LongType()
        fields = [
            T.StructField("numbers", numbers), T.StructField("last_us", long), T.StructField("n_rows", long),
            T.StructField("due_ms", long), T.StructField("beat_us", long), T.StructField("first_us", long), T.StructField("n_runs", long),
            T.StructField("shown", numbers), *self.ties,
        ]
        row = T.StructType([T.StructField("us", long), *self.ties, *[T.StructField(f"v{i}", T.DoubleType()) for i in range(len(self.kernel.inputs))]])
        self.machine = handle.getValueState("machine", T.StructType(fields))
        self.waiting = handle.getMapState("waiting", "us long, run long", T.StructType([T.StructField("rows", T.ArrayType(row))]))
        self.handle = handle

    def close(self) -> None:
        pass

    # ---- state ------------------------------------------------------------------------

    def _read(self) -> None:
        got = self.machine.get()
        self.held: list[tuple] = []
        if got is None:
            self.numbers, self.last, self.n_rows, self.due, self.beat, self.shown = self.kernel.init(), None, 0, None, None, None
            self.first, self.n_runs = None, 0
        else:
            numbers, us, self.n_rows, self.due, self.beat, self.first, self.n_runs, shown, *ties = got
            self.numbers, self.shown = list(numbers), None if shown is None else list(shown)
            self.last = None if us is None else (us, *ties)

    def _write(self) -> None:
        last = self.last or (None, *[None] * len(self.ties))
        numbers = [float(v) for v in self.numbers]
        self.machine.update((numbers, last[0], self.n_rows, self.due, self.beat, self.first, self.n_runs, self.shown, *last[1:]))

    def _set_timer(self) -> None:
        """One timer: the next waiting instant, heartbeat or end of life."""
        wanted = [] if self.first is None else [self.first // 1000 + 1]
        if self.beat is not None:
            wanted.append(self.beat // 1000)
        if self.ttl_ms is not None and self.last is not None and self.first is None:
            wanted.append(self.last[0] // 1000 + self.ttl_ms)
        due = min(wanted, default=None)
        if due != self.due:
            if self.due is not None:
                self.handle.deleteTimer(self.due)
            if due is not None:
                self.handle.registerTimer(due)
            self.due = due

    # ---- rows -------------------------------------------------------------------------

    def _take(self, pdf: pd.DataFrame) -> list[tuple]:
        """Holds the rows; returns the late ones' positions."""
        late = []
        columns = [pdf[c].tolist() for c in ("us__", *self.tie_names, *self.kernel.inputs)]
        n = 1 + len(self.tie_names)
        for row in zip(*columns, strict=True):
            if self.last is not None and row[:n] <= self.last:
                late.append(row[:n])
            else:
                self.held.append((*row[:n], *[float(v) if v is not None else math.nan for v in row[n:]]))
        if len(self.held) > HELD_ROWS:
            self._put()
        return late

    def _put(self) -> None:
        """Held rows become waiting runs."""
        self.held.sort()
        for i in range(0, len(self.held), RUN_ROWS):
            self.waiting.updateValue((self.held[i][0], self.n_runs), (self.held[i : i + RUN_ROWS],))
            self.n_runs += 1
        if self.held:
            self.first = self.held[0][0] if self.first is None else min(self.first, self.held[0][0])
            self.held = []

    def _release(self, upto_us: int | None) -> list[tuple]:
        """Steps the kernel over held and waiting rows before ``upto_us``; returns emitted rows."""
        runs = [] if self.first is None else sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        heap, out, n, at = self.held, [], 1 + len(self.ties), 0
        heapq.heapify(heap)
        while heap or at < len(runs):
            next_us = min(r[0] for r in (heap[:1] + runs[at : at + 1]))
            if upto_us is not None and next_us >= upto_us:
                break
            if at < len(runs) and runs[at][0] == next_us:
                for row in self.waiting.getValue(runs[at])[0]:
                    heapq.heappush(heap, tuple(row))
                self.waiting.removeKey(runs[at])
                at += 1
                continue
            row = heapq.heappop(heap)
            out += self._beats(row[0])
            self.n_rows += 1
            self.numbers, emitted = self.kernel.step(self.numbers, *row[n:])
            self.last = row[:n]
            for values in emitted:
                self.shown = [float(v) for v in values]
                out.append((*self.last, *values, self.n_rows, ROW))
            if self.beat_ms and self.beat is None:
                step = self.beat_ms * 1000
                self.beat = (row[0] // step + 1) * step
        if upto_us is not None:
            out += self._beats(upto_us)
        self.first = runs[at][0] if at < len(runs) else None
        self._put()
        return out

    def _beats(self, upto_us: int) -> list[tuple]:
        """Heartbeats at or before an instant, and before the key's end of life."""
        out = []
        while self.beat is not None and self.beat <= upto_us:
            if self.ttl_ms is not None and self.beat > self.last[0] + self.ttl_ms * 1000:
                self.beat = None
                break
            shown = self.shown or [None] * len(self.names)
            out.append((self.beat, *[None] * len(self.ties), *shown, self.n_rows, BEAT))
            self.beat += self.beat_ms * 1000
        return out

    def _table(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = ["us__", *self.tie_names, *self.names, "n_rows", "kind"]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        out = {f"k{i}__": pd.Series([k] * len(rows), dtype=object) for i, k in enumerate(key)}
        return pd.DataFrame(out | {n: pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._read()
        late: list[tuple] = []
        for pdf in rows:
            late += self._take(pdf)
        out = [(*at, *[None] * len(self.names), None, LATE) for at in late]
        if self.waits:
            self._put()
            self._set_timer()
        else:
            out += self._release(None)
        self._write()
        if out:
            yield self._table(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._read()
        self.due = None
        now = timerValues.getCurrentWatermarkInMs()
        out = self._release(now * 1000)
        if self.first is None and self.ttl_ms is not None and self.last is not None and self.last[0] // 1000 + self.ttl_ms <= now:
            self.machine.clear()
        else:
            self._set_timer()
            self._write()
        if out:
            yield self._table(key, out)


def keyed_kernel(
    df: DataFrame, key: str | Sequence[str], order: Sequence[str], kernel: SequentialKernel,
    delay: str | None = None, beat_ms: int | None = None, ttl_ms: int | None = None,
) -> DataFrame:
    """Key, order columns, the kernel's outputs, ``n_rows`` (rows of the key released so far)
    and ``kind`` (``row``, ``late`` or ``beat``). The first order column is an instant.

    A null input reaches the kernel as NaN. Heartbeats and the end of life follow the event
    clock, so they need ``delay``.
    """
    if delay is None and (beat_ms or ttl_ms):
        raise ValueError("heartbeats and expiry follow the watermark: give a delay")
    use_typed_state(df.sparkSession)
    keys, ts = as_list(key), order[0]
    ties = [df.schema[c] for c in order[1:]]
    fields = T._parse_datatype_string(kernel.outputs).fields
    names = [f.name for f in fields]
    marked = df.withWatermark(ts, delay) if delay is not None else df
    # a copy of the instant carries no watermark, so late rows arrive and can be flagged
    slim = marked.select(
        *[F.col(k).alias(f"k{i}__") for i, k in enumerate(keys)], F.unix_micros(ts).alias("us__"),
        *order[1:], *[c for c in kernel.inputs if c not in order[1:]],
    )
    schema = T.StructType(
        [T.StructField(f"k{i}__", df.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField("us__", T.LongType()), *[T.StructField(f.name, f.dataType) for f in ties], *fields]
        + [T.StructField("n_rows", T.LongType()), T.StructField("kind", T.StringType())]
    )
    machine = _Machine(kernel, ties, names, delay is not None, beat_ms, ttl_ms)
    mode = "None" if delay is None else "EventTime"
    out = slim.groupBy(*[f"k{i}__" for i in range(len(keys))]).transformWithStateInPandas(machine, schema, "Append", mode)
    return out.select(
        *[F.col(f"k{i}__").alias(k) for i, k in enumerate(keys)], F.timestamp_micros("us__").alias(ts), *order[1:], *names, "n_rows", "kind"
    )


def in_time(df: DataFrame) -> DataFrame:
    """The released rows alone, as the batch job has them."""
    return df.filter(F.col("kind") == ROW).drop("n_rows", "kind")
