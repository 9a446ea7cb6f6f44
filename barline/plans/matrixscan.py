"""Recurrence ``x[t] = A[t] x[t-1] + b[t]`` with a vector state, in blocks and a tree of blocks.

Maps of this form can be composed, so a block of rows folds to one map, and ``RADIX``
neighbouring blocks fold to one map of the level above, until a key has one group left.
On the way down each group starts from the state that its parent was given, and hands a
start to each of its members. A task sees one block of rows or one group of maps, and the
number of rounds is the logarithm of the blocks of the longest key.

The same plan serves sums of products (``plus``) and maxima of sums (``max``), where
``x[t]`` is the larger of ``A[t] x[t-1]`` and ``b[t]``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.plans.sequential import new_run_flags, sorted_runs
from barline.plans.series import Series
from barline.sources.sinks import materialize

RADIX = 256
KINDS = ("plus", "max")
#: (A, b) of a batch of rows from its input columns: arrays (rows, n, n) and (rows, n).
Terms = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]


def identity(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    if kind == "plus":
        return np.eye(n), np.zeros(n)
    return np.where(np.eye(n) > 0, 0.0, -np.inf), np.full(n, -np.inf)


def act(kind: str, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States after stacked maps."""
    if kind == "plus":
        return (a @ x[..., None])[..., 0] + b
    return np.maximum((a + x[..., None, :]).max(axis=-1), b)


def compose(kind: str, later: tuple, earlier: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Stacked maps ``later`` after ``earlier``."""
    a, b = later
    a0, b0 = earlier
    if kind == "plus":
        return a @ a0, act(kind, a, b, b0)
    return (a[..., :, :, None] + a0[..., None, :, :]).max(axis=-2), act(kind, a, b, b0)


def _padded(kind: str, a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    more = rows - len(a)
    if not more:
        return a, b
    ia, ib = identity(kind, b.shape[1])
    return np.concatenate((a, np.repeat(ia[None], more, 0))), np.concatenate((b, np.repeat(ib[None], more, 0)))


def fold(kind: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one map that all rows make together."""
    while len(a) > 1:
        a, b = _padded(kind, a, b, len(a) + len(a) % 2)
        a, b = compose(kind, (a[1::2], b[1::2]), (a[::2], b[::2]))
    return a[0], b[0]


def scan(kind: str, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """State after each row. Rows lie in stretches that are composed side by side."""
    rows, n = b.shape
    width = max(int(np.sqrt(rows)), 1)
    stretches = -(-rows // width)
    a, b = _padded(kind, a, b, stretches * width)
    p, q = a.reshape(stretches, width, n, n).copy(), b.reshape(stretches, width, n).copy()
    for j in range(1, width):
        p[:, j], q[:, j] = compose(kind, (p[:, j], q[:, j]), (p[:, j - 1], q[:, j - 1]))
    starts = np.empty((stretches, n))
    x = start
    for i in range(stretches):
        starts[i] = x
        x = act(kind, p[i, -1], q[i, -1], x)
    return act(kind, p, q, starts[:, None, :]).reshape(-1, n)[:rows]


def _stretches(batches: Iterator[pd.DataFrame], parts: Sequence[str], inputs: Sequence[str], terms: Terms):
    """(batch, first row, end, whether a run begins, A, b) of the runs in each batch."""
    last_key = None
    for pdf in batches:
        if not len(pdf):
            continue
        fresh = np.asarray(new_run_flags(pdf, parts, last_key))
        last_key = tuple(pdf[p].iloc[-1] for p in parts)
        a, b = terms({c: pdf[c].to_numpy(dtype=float) for c in inputs})
        edges = [*np.unique([0, *np.flatnonzero(fresh)]).tolist(), len(pdf)]
        for low, high in zip(edges, edges[1:]):
            yield pdf, low, high, bool(fresh[low]), a[low:high], b[low:high]


def _states(parts, keep, inputs, names, terms, init, kind):
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = None
        for pdf, low, high, begins, a, b in _stretches(batches, parts, inputs, terms):
            if begins:
                given = pdf["__x0"].iloc[low] if "__x0" in pdf.columns else None
                x = np.asarray(init if given is None else given, float)
            states = scan(kind, a, b, x)
            x = states[-1]
            out = pdf[keep].iloc[low:high].reset_index(drop=True)
            yield out.assign(**{name: states[:, i] for i, name in enumerate(names)})

    return apply


def _folds(parts, inputs, terms, kind):
    def row(key: tuple, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame([key], columns=list(parts))
        out["__A"], out["__b"] = [a.ravel().tolist()], [b.tolist()]
        return out

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, a, b = None, None, None
        for pdf, low, high, begins, a1, b1 in _stretches(batches, parts, inputs, terms):
            here = fold(kind, a1, b1)
            if not begins:
                a, b = compose(kind, here, (a, b))
                continue
            if key is not None:
                yield row(key, a, b)
            key, (a, b) = tuple(pdf[p].iloc[low] for p in parts), here
        if key is not None:
            yield row(key, a, b)

    return apply


def _maps(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    b = np.stack(pdf["__b"].to_numpy())
    return np.stack(pdf["__A"].to_numpy()).reshape(len(pdf), b.shape[1], b.shape[1]), b


def block_starts(folds: DataFrame, key: Sequence[str], init: Sequence[float], kind: str = "plus", radix: int = RADIX) -> DataFrame:
    """Start state ``__x0`` of each block: ``key``, ``__blk``, ``__x0``.

    ``folds`` holds one map per block, ``__A`` (row by row) and ``__b``; block numbers grow
    along the order and may have gaps. A key without blocks has no rows.
    """
    key = list(key)
    fields = [folds.schema[k] for k in key] + [T.StructField("__blk", T.LongType())]
    doubles = T.ArrayType(T.DoubleType())
    up_schema = T.StructType([*fields, T.StructField("__A", doubles), T.StructField("__b", doubles)])
    down_schema = T.StructType([*fields, T.StructField("__x0", doubles)])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__blk")
        a, b = fold(kind, *_maps(pdf))
        out = pdf[[*key, "__up"]].head(1).rename(columns={"__up": "__blk"})
        out["__A"], out["__b"] = [a.ravel().tolist()], [b.tolist()]
        return out

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__blk")
        start = np.asarray(pdf["__x0"].iloc[0], float)
        after = scan(kind, *_maps(pdf), start)
        out = pdf[[*key, "__blk"]].copy()
        out["__x0"] = [start.tolist(), *after[:-1].tolist()]
        return out

    def grouped(d: DataFrame):
        return d.groupBy(*[F.col(k) for k in key], F.col("__up"))

    levels = [materialize(folds.select(*key, F.col("__blk").cast("long").alias("__blk"), "__A", "__b"), "block-maps")]
    parent = F.floor(F.col("__blk") / F.lit(radix)).cast("long").alias("__up")
    top = levels[0].agg(F.max("__blk")).collect()[0][0] or 0
    while top >= radix:
        levels.append(materialize(grouped(levels[-1].select("*", parent)).applyInPandas(together, up_schema), "block-maps"))
        top //= radix
    starts = None
    for level in reversed(levels):
        members = level.select("*", parent)
        if starts is None:
            members = members.withColumn("__x0", F.array(*[F.lit(float(v)) for v in init]))
        else:
            above = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__blk").alias("__cb"), "__x0")
            members = members.join(above, _same(key, "__up"))
            members = members.select(*level.columns, "__up", "__x0")
        starts = grouped(members).applyInPandas(apart, down_schema)
    return starts


def _same(key: Sequence[str], block: str):
    cond = F.col(block) == F.col("__cb")
    for i, k in enumerate(key):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return cond


def with_starts(rows: DataFrame, starts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of blocks with the start state ``__x0`` of their block."""
    named = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__blk").alias("__cb"), "__x0")
    return rows.join(named, _same(key, "__blk"), "left").select(*rows.columns, "__x0")


def _block_maps(slim: Series, terms: Terms, inputs: Sequence[str], kind: str) -> tuple[DataFrame, DataFrame, list[str]]:
    df, fr = slim.blocks()
    parts = list(fr.parts)
    fields = [df.schema[p] for p in parts] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__A", "__b")]
    folds = sorted_runs(df, parts, slim.order).mapInPandas(_folds(parts, inputs, terms, kind), T.StructType(fields))
    return df, folds, parts


def matrix_scan(series: Series, inputs: Sequence[str], names: Sequence[str], terms: Terms, init: Sequence[float], kind: str = "plus") -> DataFrame:
    """Key and order columns with the state after each row as columns ``names``.

    ``terms`` makes the maps of a batch from the numeric columns ``inputs``. An empty table
    gives an empty one; equal positions of the order are taken in any order.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    keep = list(dict.fromkeys([*series.key, *series.order]))
    inputs, names = list(inputs), list(names)
    schema = T.StructType([series.df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in names])
    slim = series.with_df(series.df.select(*dict.fromkeys([*keep, *inputs])))
    rows, parts = slim.df, list(series.key)
    if series.is_split():
        rows, folds, parts = _block_maps(slim.with_df(slim.df), terms, inputs, kind)
        rows = with_starts(rows, block_starts(folds, series.key, init, kind), series.key)
    return sorted_runs(rows, parts, series.order).mapInPandas(_states(parts, keep, inputs, names, terms, init, kind), schema)


def matrix_fold(series: Series, inputs: Sequence[str], names: Sequence[str], terms: Terms, init: Sequence[float], kind: str = "plus") -> DataFrame:
    """One row per key: the state after its last row as columns ``names``."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    key, inputs = list(series.key), list(inputs)
    slim = series.with_df(series.df.select(*dict.fromkeys([*key, *series.order, *inputs])))
    split = series.is_split()
    _, folds, parts = _block_maps(slim.with_df(slim.df), terms, inputs, kind)
    last = folds
    if split:
        folds = materialize(folds, "block-maps")
        latest = folds.groupBy(*key).agg(F.max_by(F.struct("__blk", "__A", "__b"), "__blk").alias("__m")).select(*key, "__m.*")
        last = with_starts(latest, block_starts(folds, key, init, kind), key)
    else:
        last = last.withColumn("__x0", F.array(*[F.lit(float(v)) for v in init]))
    schema = T.StructType([series.df.schema[k] for k in key] + [T.StructField(c, T.DoubleType()) for c in names])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                states = act(kind, *_maps(pdf), np.stack(pdf["__x0"].to_numpy()).astype(float))
                yield pdf[key].assign(**{name: states[:, i] for i, name in enumerate(names)})

    return last.mapInPandas(ends, schema)
