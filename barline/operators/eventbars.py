"""Order-dependent bars: range, ATR range, reset tick bars, boxes, Heiken-Ashi."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import kernels as K
from barline.operators.bars import segments
from barline.plans.scan import affine, lookback
from barline.plans.sequential import run_kernel
from barline.plans.series import Series, as_list


def _with_clock(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("at", F.unix_micros(ts).cast("double"))


def _numbered_bars(bars: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    out = Series(bars, keys, order).numbered("bar_id")
    return out.select(
        *keys, (F.col("bar_id") - 1).alias("bar_id"), F.timestamp_micros("start_us").alias("ts"),
        F.col(order[0]).alias("available_at"), "open", "high", "low", "close", "volume", "n_ticks",
    )


def range_bars(
    df: DataFrame,
    key: str | Sequence[str],
    width: float,
    max_gap_us: int,
    order: Sequence[str] = ("ts", "tie"),
    atr: tuple[int, float, float, float] | None = None,
) -> DataFrame:
    """Range bars, restarted at each gap longer than ``max_gap_us``."""
    keys = [*as_list(key), "segment"]
    seg = _with_clock(segments(df, key, order, max_gap_us), order[0])
    bars = run_kernel(Series(seg, keys, list(order)), K.range_bar(width, atr))
    return _numbered_bars(bars, keys, order)


def tick_reset_bars(df: DataFrame, key: str | Sequence[str], threshold: float, order: Sequence[str] = ("ts", "tie")) -> DataFrame:
    keys = as_list(key)
    bars = run_kernel(Series(_with_clock(df, order[0]), keys, list(order)), K.tick_reset_bar(threshold))
    return _numbered_bars(bars, keys, order)


def box_columns(
    df: DataFrame, key: str | Sequence[str], box: float, reversal: int, order: Sequence[str] = ("ts", "tie")
) -> DataFrame:
    """Boxes with running box and column numbers.

    Boxes are numbered after the walk, so the walk keeps no counters.
    """
    keys = as_list(key)
    boxes = run_kernel(Series(df, keys, list(order)), K.box_column(box, reversal))
    # boxes of one price share its stamp; inside a column the level itself is the order
    step = F.col("level") * F.col("direction")
    s = Series(boxes.withColumn("__step", step), keys, [*order, "__step"])
    run = s.running({"box_id": ("count", F.lit(1)), "column_id": ("sum", F.col("new_column"))})
    return run.withColumn("box_id", F.col("box_id") - 1).withColumn("column_id", F.col("column_id") - 1).drop("__step")


def box_consistency(boxes: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """(ups - downs) / n over the last ``n`` box-to-box level changes."""
    s = Series(boxes, key, ["box_id"])

    def stage(d, fr):
        d = d.withColumn("__d", F.signum(F.col("level") - F.lag("level").over(fr.w())))
        full = F.count("__d").over(fr.last_n(n)) == n
        return d.withColumn("consistency", F.when(full, F.sum("__d").over(fr.last_n(n)) / n)).drop("__d")

    return s.map(stage, back_rows=n + 1)


def zigzag_levels(df: DataFrame, key: str | Sequence[str], min_swing: float, order: Sequence[str] = ("ts",)) -> DataFrame:
    return run_kernel(Series(df, key, list(order)), K.zigzag(min_swing))


def heiken_ashi(df: DataFrame, key: str | Sequence[str], order: Sequence[str] = ("ts",), bounded_rows: int | None = None) -> DataFrame:
    """open = (previous HA open + previous HA close) / 2, an affine scan with a = 1/2."""
    s = Series(df, key, list(order), bounded_rows)

    def stage(d, fr):
        d = d.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
        first = F.row_number().over(fr.w()) == 1
        b = F.when(first, (F.col("open") + F.col("close")) / 2).otherwise(F.lag("ha_close").over(fr.w()) / 2)
        d = affine(d.withColumn("__b", b), fr, "ha_open", 0.5, F.col("__b")).drop("__b")
        return d.withColumn("ha_high", F.greatest("high", "ha_open", "ha_close")).withColumn(
            "ha_low", F.least("low", "ha_open", "ha_close")
        )

    return s.map(stage, back_rows=lookback(0.5) + 2)

