"""Indicators around sequential kernels and swings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import kernels as K
from barline.operators.indicators.scans import add_atr, wrows
from barline.plans.sequential import run_kernel
from barline.plans.series import Series


def parabolic_sar(series: Series) -> DataFrame:
    """Stop-and-reverse level, side, and distance of the close from it."""
    sar = run_kernel(series, K.parabolic_sar())
    return series.df.join(sar, [*series.key, *series.order]).withColumn("psar_delta", F.col("close") - F.col("sar"))


def super_trend(series: Series, n: int = 10, mult: float = 3.0) -> DataFrame:
    """Bands start on the bar after the mean range is known."""

    def stage(d, fr):
        d = add_atr(d, fr, "__atr", n)
        return d.withColumn("st_atr", F.when(F.lag("__atr").over(fr.w()).isNotNull(), F.col("__atr"))).drop("__atr")

    with_atr = series.with_df(series.map(stage, back_rows=wrows(n) + 2))
    out = run_kernel(with_atr, K.super_trend(mult))
    level = F.when(F.isnan("st_level"), F.lit(None)).otherwise(F.col("st_level"))
    return series.df.join(out, [*series.key, *series.order]).withColumn("st_level", level).withColumn(
        "st_dir", F.when(F.col("st_level").isNotNull(), F.col("st_dir")))


def local_extremes(series: Series, hi: str = "high", lo: str = "low") -> DataFrame:
    """Stage 1: bars above (below) both neighbours, known one bar later."""

    def stage(d, fr):
        w = fr.w()
        up = (F.col(hi) > F.lag(hi).over(w)) & (F.col(hi) > F.lead(hi).over(w))
        dn = (F.col(lo) < F.lag(lo).over(w)) & (F.col(lo) < F.lead(lo).over(w))
        marks = F.array(
            F.when(up, F.struct(F.lit(1).alias("is_high"), F.col(hi).cast("double").alias("value"))),
            F.when(dn, F.struct(F.lit(0).alias("is_high"), F.col(lo).cast("double").alias("value"))),
        )
        return d.withColumn("__next", F.lead(series.order[0]).over(w)).withColumn("__m", F.filter(marks, lambda x: x.isNotNull()))

    d = series.map(stage, back_rows=1, fwd_rows=1).filter(F.size("__m") > 0)
    # a bar that is both gives its high first
    ex = d.select(*series.key, *series.order, F.col("__next").alias("confirmed_at"), F.posexplode("__m").alias("slot", "x"))
    return ex.select(*series.key, *series.order, "slot", "confirmed_at", "x.is_high", "x.value")


def alternating(extremes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stage 2: the most extreme point of each run of equal type; the first one on ties."""
    o = [*order, "slot"]
    s = Series(extremes, key, o)
    flagged = s.columns(
        lambda fr: {"__new": F.coalesce((F.col("is_high") != F.lag("is_high").over(fr.w())).cast("int"), F.lit(1))}, back_rows=1)
    run = s.with_df(flagged).running({"__run": ("sum", F.col("__new"))})
    signed = F.when(F.col("is_high") == 1, F.col("value")).otherwise(-F.col("value"))
    best = F.min(F.struct((-signed).alias("s"), *[F.col(x) for x in o], F.col("value"), F.col("confirmed_at"), F.col("is_high")))
    g = run.groupBy(*key, "__run").agg(best.alias("b"), F.max("confirmed_at").alias("run_end"))
    return g.select(*key, *[F.col(f"b.{x}").alias(x) for x in o], F.col("b.value").alias("value"),
                    F.col("b.is_high").alias("is_high"), F.col("b.confirmed_at").alias("confirmed_at"), "run_end")


def swings(series: Series, hi: str = "high", lo: str = "low") -> DataFrame:
    """Confirmed swings: stages 1-2 as windows, stage 3 a small walk over the swings only.

    ``confirmed_at`` is when the extreme itself is known; ``settled_at`` is when
    the next opposite extreme closes the run that chose it.  Causal consumers
    use ``settled_at``.
    """
    key, order = list(series.key), list(series.order)
    alt = alternating(local_extremes(series, hi, lo), key, order)
    o = [*order, "slot"]
    a = Series(alt, key, o)
    alt = a.columns(lambda fr: {"settled_at": F.lead("confirmed_at").over(fr.w())}, fwd_rows=1)
    kept = run_kernel(Series(alt, key, o), K.swing_gate())
    return alt.join(kept, [*key, *o]).filter("kept = 1").drop("kept", "run_end")


def swing_features(series: Series, known: str = "settled_at") -> DataFrame:
    """Active swing levels, 5-state code, range position, higher-high / higher-low flags."""
    key, order = list(series.key), list(series.order)
    ts = order[0]
    sw = swings(series)

    # value of the previous swing of the same type
    prev = Series(sw, [*key, "is_high"], [*order, "slot"]).columns(lambda fr: {"prev_value": F.lag("value").over(fr.w())}, back_rows=1)

    state = prev.filter(F.col(known).isNotNull()).select(
        *key, F.col(known).alias("available_at"), "slot",
        F.when(F.col("is_high") == 1, F.struct("value", "prev_value")).alias("__h"),
        F.when(F.col("is_high") == 0, F.struct("value", "prev_value")).alias("__l"),
        "is_high",
    )
    run = Series(state, key, ["available_at", "is_high", "slot"]).running(
        {"hs": ("last", F.col("__h")), "ls": ("last", F.col("__l")), "last_high": ("last", F.col("is_high"))}
    )
    # one state row per instant
    latest = run.groupBy(*key, "available_at").agg(F.max_by(F.struct("hs", "ls", "last_high"), F.struct("is_high", "slot")).alias("x")).select(
        *key, "available_at", "x.*")
    from barline.operators.asof import asof

    j = asof(series.df, latest, key, left_ts=ts)
    hv, lv = F.col("hs.value"), F.col("ls.value")
    m = F.col("close")
    side = F.when(F.col("last_high") == 1, -1).otherwise(1)
    both = hv.isNotNull() & lv.isNotNull()
    code = F.when(both, F.when(m > hv, 2).when(m < lv, -2).otherwise(side)).when(
        hv.isNotNull(), F.when(m <= hv, -1).otherwise(2)).when(lv.isNotNull(), F.when(m >= lv, 1).otherwise(-2)).otherwise(0)
    pos = F.when(both & (hv > lv), (m - lv) / (hv - lv))
    four = F.col("hs.prev_value").isNotNull() & F.col("ls.prev_value").isNotNull()
    return j.select(
        *series.df.columns, hv.alias("swing_high"), lv.alias("swing_low"), code.alias("swing_state"), pos.alias("swing_pos"),
        F.when(four, (hv > F.col("hs.prev_value")).cast("int")).alias("hh"),
        F.when(four, (lv > F.col("ls.prev_value")).cast("int")).alias("hl"),
    ).drop("hs", "ls", "last_high")


