"""Order-dependent kernels (stops, range bars, boxes, zigzag, thinning).

A kernel is a pair ``init() -> state`` and ``step(state, *values) -> (state, rows)``
with a flat list of floats as state.  The same object drives the batch job here
and the keyed streaming state in ``barline.streaming``.

Batch: one task walks one key, or one *block* of a hot key.  A block does not
know the state it starts from, so it first warms up on halo rows of the
preceding block.  Every block then reports its entry and exit state; where the
entry differs from the exit of the block before, that block is run again from
the true state, until all agree.  Results are therefore exact, each task sees
a bounded number of rows, and usually one round is enough because such
machines forget their start.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.plans.series import Series
from barline.session import shared_dir

HALO_ROWS = 4096
STATE_TOLERANCE = 1e-9


@dataclass(frozen=True)
class SequentialKernel:
    """``inputs`` are numeric columns; ``outputs`` a schema of the emitted columns."""

    inputs: tuple[str, ...]
    outputs: str
    init: Callable[[], list[float]]
    step: Callable[..., tuple[list[float], list[tuple]]]


def same_state(a: Sequence[float], b: Sequence[float]) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if math.isnan(x) and math.isnan(y):
            continue
        if not abs(x - y) <= STATE_TOLERANCE * max(1.0, abs(x), abs(y)):
            return False
    return True


def walk(kernel: SequentialKernel, state: list[float], columns: list[list[float]]):
    """Advance a state over sorted rows; returns it with the (row index, emitted tuple) list."""
    emitted = []
    for i, values in enumerate(zip(*columns)):
        state, rows = kernel.step(state, *values)
        emitted += [(i, r) for r in rows]
    return state, emitted


def runs(kernel: SequentialKernel, parts: Sequence[str], keep: Sequence[str], names: Sequence[str], start_column: str | None):
    """Partition function: walk sorted rows, restarting where ``parts`` changes.

    Batches stream through, so a long run is never held in memory as a whole.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, state = None, None
        step = kernel.step
        for pdf in batches:
            if not len(pdf):
                continue
            fresh = new_run_flags(pdf, parts, last_key)
            last_key = tuple(pdf[p].iloc[-1] for p in parts)
            starts = pdf[start_column].tolist() if start_column else None
            columns = [pdf[c].astype("float64").tolist() for c in kernel.inputs]
            rows, idx = [], []
            for i, values in enumerate(zip(*columns)):
                if fresh[i]:
                    state = list(starts[i]) if starts else kernel.init()
                state, out = step(state, *values)
                for r in out:
                    rows.append(r)
                    idx.append(i)
            res = pdf[list(keep)].iloc[idx].reset_index(drop=True)
            for j, n in enumerate(names):
                res[n] = [r[j] for r in rows]
            yield res

    return apply


def new_run_flags(pdf: pd.DataFrame, parts: Sequence[str], last_key: tuple | None) -> list[bool]:
    first = last_key is None or tuple(pdf[p].iloc[0] for p in parts) != last_key
    if not parts:
        flags = np.zeros(len(pdf), dtype=bool)
        flags[0] = last_key is None
        return flags.tolist()
    changed = np.zeros(len(pdf), dtype=bool)
    for p in parts:
        v = pdf[p].to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    changed[0] = first
    return changed.tolist()


def measure(kernel: SequentialKernel, parts: Sequence[str]):
    """Partition function: one (entry, exit) state row per block."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, state, entry = None, None, None
        done: list[tuple] = []

        def close():
            if last_key is not None and entry is not None:
                done.append((last_key, entry, list(state)))

        for pdf in batches:
            if not len(pdf):
                continue
            fresh = new_run_flags(pdf, parts, last_key)
            keys = list(zip(*[pdf[p].tolist() for p in parts]))
            own = pdf["__own"].tolist()
            given = pdf["__given"].tolist() if "__given" in pdf.columns else [None] * len(pdf)
            columns = [pdf[c].astype("float64").tolist() for c in kernel.inputs]
            for i, values in enumerate(zip(*columns)):
                if fresh[i]:
                    close()
                    last_key, state, entry = keys[i], kernel.init(), None
                if own[i] and entry is None:
                    if given[i] is not None:
                        state = [float(x) for x in given[i]]
                    entry = [float(x) for x in state]
                state, _ = kernel.step(state, *values)
        close()
        if done:
            out = pd.DataFrame([k for k, _, _ in done], columns=list(parts))
            out["__entry"] = [e for _, e, _ in done]
            out["__exit"] = [[float(x) for x in s] for _, _, s in done]
            yield out

    return apply


def sorted_runs(df: DataFrame, parts: Sequence[str], order: Sequence[str]) -> DataFrame:
    cols = [F.col(p) for p in parts]
    clustered = df.repartition(*cols) if cols else df.repartition(1)
    return clustered.sortWithinPartitions(*cols, *[F.col(o) for o in order])


def run_kernel(series: Series, kernel: SequentialKernel, halo_rows: int = HALO_ROWS) -> DataFrame:
    """Emitted rows with key and order columns of the row that caused them."""
    keep = list(dict.fromkeys([*series.key, *series.order]))
    order = list(series.order)
    out_fields = T._parse_datatype_string(kernel.outputs).fields
    names = [f.name for f in out_fields]
    slim_cols = list(dict.fromkeys([*keep, *kernel.inputs]))
    schema = T.StructType(
        [T.StructField(c, series.df.schema[c].dataType, True) for c in keep] + list(out_fields)
    )
    split = series.is_split()
    slim = series.with_df(series.df.select(*slim_cols))
    if not split:
        parts = list(series.key)
        return sorted_runs(slim.df, parts, order).mapInPandas(runs(kernel, parts, keep, names, None), schema)

    df, fr = slim.blocks(back_rows=min(halo_rows, series.block_rows))
    parts, key_cols = list(fr.parts), list(series.key)
    # a block id that holds only halo copies has nothing to report
    df = df.join(df.filter(F.col("__own")).select(*parts).distinct(), parts, "left_semi")
    state_schema = T.StructType(
        [df.schema[p] for p in parts]
        + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("__entry", "__exit")]
    )
    spark = series.df.sparkSession
    base = shared_dir(spark, f"kernel-{uuid.uuid4().hex}")
    sorted_runs(df, parts, order).mapInPandas(measure(kernel, parts), state_schema).write.parquet(f"{base}/0")
    states = spark.read.parquet(f"{base}/0")
    agrees = F.udf(lambda a, b: b is None or (a is not None and same_state(a, b)), "boolean")
    by_key = Window.partitionBy(*[F.col(k) for k in key_cols]) if key_cols else Window.partitionBy(F.lit(0))
    rnd = 0
    while True:
        checked = states.withColumn("__given", F.lag("__exit").over(by_key.orderBy("__blk")))
        wrong = checked.filter(~agrees("__entry", "__given")).select(*parts, "__given")
        if not wrong.take(1):
            break
        rnd += 1
        again = sorted_runs(df.join(wrong, parts), parts, order).mapInPandas(measure(kernel, parts), state_schema)
        kept = states.join(wrong.select(*parts), parts, "left_anti")
        kept.unionByName(again).write.parquet(f"{base}/{rnd}")
        states = spark.read.parquet(f"{base}/{rnd}")
    start = states.select(*parts, F.col("__entry").alias("__given"))
    own = df.filter(F.col("__own")).join(start, parts)
    return sorted_runs(own, parts, order).mapInPandas(runs(kernel, parts, keep, names, "__given"), schema)
