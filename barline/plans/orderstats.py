"""Rolling order statistics in one pass over sorted runs.

A window frame that collects its rows and scans them costs O(n) per row. Here a task walks
the sorted rows of a key (or of a block of a hot key, behind its halo) once and keeps the
last ``n`` values in a sorted window: a row enters and leaves by binary search, quantiles
are read by place, ranks by search, and the median absolute deviation by a search from both
ends of the window, so a row costs O(log n) steps. Windows live across Arrow batches; no
key is held in memory.

As in the window form, nulls are left out and a value is null until the frame holds ``n``
values, or, with ``partial=True``, while it holds none. NaN counts as infinity.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.plans.sequential import sorted_runs
from barline.plans.series import Frame


@dataclass(frozen=True)
class OrderStat:
    """``kind`` of the last ``n`` values of a column: ``quantile`` (``p``, interpolated),
    ``rank`` (average-tie rank of the current value divided by n), ``mad`` (median absolute
    deviation around the median) or ``deviation`` (mean absolute distance from the column
    ``centre``)."""

    kind: str
    column: str
    n: int
    p: float = 0.5
    partial: bool = False
    centre: str | None = None


def quantile(window: Sequence[float], p: float) -> float:
    at = p * (len(window) - 1)
    low = math.floor(at)
    part = at - low
    return window[low] if not part else window[low] + part * (window[low + 1] - window[low])


def rank(window: Sequence[float], x: float) -> float:
    below = bisect_left(window, x)
    return (below + (bisect_right(window, x, below) - below + 1) / 2) / len(window)


def _nth_deviation(window: Sequence[float], centre: float, split: int, k: int) -> float:
    """The k-th smallest (from 0) distance from a centre. Left of ``split`` distances grow
    to the left, right of it to the right: two sorted lists, of which the first k + 1 are
    divided by binary search."""
    left, right = split, len(window) - split
    low, high = max(0, k + 1 - right), min(k + 1, left)
    while low < high:
        take = (low + high) // 2  # of the left list; the rest of k + 1 from the right one
        if centre - window[split - 1 - take] < window[split + k - take] - centre:
            low = take + 1
        else:
            high = take
    best = 0.0
    if low:
        best = centre - window[split - low]
    if k + 1 - low:
        best = max(best, window[split + k - low] - centre)
    return best


def median_deviation(window: Sequence[float], centre: float) -> float:
    split, n = bisect_left(window, centre), len(window)
    high = _nth_deviation(window, centre, split, n // 2)
    return high if n % 2 else (_nth_deviation(window, centre, split, n // 2 - 1) + high) / 2


def mean_deviation(window: Sequence[float], centre: float) -> float:
    split = bisect_left(window, centre)
    below, above = window[:split], window[split:]
    return (centre * len(below) - sum(below) + sum(above) - centre * len(above)) / len(window)


class _Window:
    """The last ``n`` rows of one column, in order of rows and sorted."""

    def __init__(self, n: int):
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.rows: deque = deque()
        self.sorted: list[float] = []

    def push(self, x: float | None) -> None:
        if len(self.rows) == self.n:
            old = self.rows.popleft()
            if old is not None:
                del self.sorted[bisect_left(self.sorted, old)]
        self.rows.append(x)
        if x is not None:
            insort(self.sorted, x)


def _reader(stat: OrderStat) -> Callable[[list[float], float | None, float | None], float | None]:
    def ready(w: list[float]) -> bool:
        return bool(w) if stat.partial else len(w) == stat.n

    if stat.kind == "quantile":
        return lambda w, x, c: quantile(w, stat.p) if ready(w) else None
    if stat.kind == "rank":
        return lambda w, x, c: rank(w, x) if x is not None and ready(w) else None
    if stat.kind == "mad":
        return lambda w, x, c: median_deviation(w, quantile(w, 0.5)) if ready(w) else None
    if stat.kind == "deviation":
        return lambda w, x, c: mean_deviation(w, c) if c is not None and ready(w) else None
    raise ValueError(f"no order statistic {stat.kind!r}")


def _numbers(column: pa.Array) -> list[float | None]:
    values = column.cast(pa.float64(), safe=False)
    return [math.inf if x is not None and x != x else x for x in values.to_pylist()]


def _walk(stats: dict[str, OrderStat], parts: Sequence[str]):
    """Partition function: the batch with one more column per statistic."""
    wanted = {(s.column, s.n) for s in stats.values()}
    readers = [((s.column, s.n), s.centre, _reader(s)) for s in stats.values()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = {k: _Window(k[1]) for k in wanted}
        before: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, before = _starts(batch, parts, before)
            columns = {c: _numbers(batch[c]) for c in {c for c, _ in wanted} | {c for _, c, _ in readers if c}}
            out: list[list] = [[] for _ in readers]
            feeds = [(w, columns[k[0]]) for k, w in windows.items()]
            reads = [(o.append, windows[k], columns[k[0]], columns.get(c), fn) for o, (k, c, fn) in zip(out, readers, strict=True)]
            for i in range(batch.num_rows):
                if fresh[i]:
                    for w in windows.values():
                        w.clear()
                for w, values in feeds:
                    w.push(values[i])
                for append, w, values, centres, fn in reads:
                    append(fn(w.sorted, values[i], centres[i] if centres else None))
            for name, values in zip(stats, out, strict=True):
                batch = batch.append_column(name, pa.array(values, pa.float64()))
            yield batch

    return apply


def _starts(batch: pa.RecordBatch, parts: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows at which another run starts, and the key of the last row."""
    fresh = np.zeros(batch.num_rows, bool)
    key = tuple(batch[p][0].as_py() for p in parts)
    fresh[0] = before is None or key != before
    for p in parts:
        codes = batch[p].dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return fresh, tuple(batch[p][batch.num_rows - 1].as_py() for p in parts)


def robust_zscores(d: DataFrame, fr: Frame, columns: dict[str, str], n: int) -> DataFrame:
    """Adds robust z-scores: ``columns`` maps an output to its input column. The distance to
    the median of the last ``n`` values over 1.4826 median absolute deviations; null where
    that is 0."""
    stats = {f"__{out}_{k}": OrderStat(kind, x, n) for out, x in columns.items() for k, kind in (("med", "quantile"), ("mad", "mad"))}
    d = order_statistics(d, fr, stats)
    z = {out: F.when(F.col(f"__{out}_mad") > 0, (F.col(x) - F.col(f"__{out}_med")) / (F.lit(1.4826) * F.col(f"__{out}_mad"))) for out, x in columns.items()}
    return d.withColumns(z).drop(*stats)


def order_statistics(d: DataFrame, fr: Frame, stats: dict[str, OrderStat]) -> DataFrame:
    """A stage of ``Series.map``: the rows with one column per statistic. The stage needs
    ``n - 1`` halo rows back."""
    parts, order = list(fr.parts), list(fr.order)
    inside = d.select(*[c for c in d.columns if c not in stats])
    schema = T.StructType([*inside.schema.fields, *[T.StructField(name, T.DoubleType()) for name in stats]])
    return sorted_runs(inside, parts, order).mapInArrow(_walk(stats, parts), schema)
