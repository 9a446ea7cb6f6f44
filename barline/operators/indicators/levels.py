"""Cumulative, session and previous-period indicators as DataFrame operators.

They keep state since the start of a key or a session, so they are not part of
the bounded-frame stage; running sums use the block carry of ``Series``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import DAY_US
from barline.functions.shape import true_range, typical
from barline.operators.bars import prev_period_levels
from barline.operators.indicators.frames import c, h, l, money_flow, swing_index, v
from barline.operators.indicators.scans import add_atr, add_ema, wrows
from barline.plans.scan import ema_rows
from barline.plans.series import Series


def cumulative(series: Series, out: str, contribution) -> DataFrame:
    """Running sum of a column that may look back one bar."""
    d = series.map(lambda x, fr: x.withColumn("__x", contribution(fr)), back_rows=1)
    return series.with_df(d).running({out: ("sum", F.col("__x"))}).drop("__x")


def obv(series: Series) -> DataFrame:
    return cumulative(series, "obv", lambda fr: F.coalesce(F.signum(c() - F.lag("close").over(fr.w())) * v(), F.lit(0.0)))


def accumulation_distribution(series: Series) -> DataFrame:
    return cumulative(series, "ad_line", lambda fr: money_flow())


def asi(series: Series) -> DataFrame:
    """Accumulated swing index."""
    return cumulative(series, "asi", lambda fr: F.coalesce(swing_index(fr), F.lit(0.0)))


LIMIT_ATR, LIMIT_TIMES = 14, 3.0  # fixed values: the limit move is three mean ranges


def add_limited_index(d: DataFrame, fr, out: str) -> DataFrame:
    """One-bar swing index against a limit of three mean true ranges (0 on the first bar);
    until the mean range has its full length it is the mean of the bars so far."""
    d = add_atr(d, fr, "__lim", LIMIT_ATR).withColumn("__ltr", true_range(fr))
    early = F.avg("__ltr").over(fr.last_n(LIMIT_ATR))
    limit = LIMIT_TIMES * F.coalesce("__lim", early)
    return d.withColumn(out, F.coalesce(swing_index(fr, limit), F.lit(0.0))).drop("__lim", "__ltr")


def limited_asi(series: Series) -> DataFrame:
    """Accumulated swing index with the limit move."""
    d = series.map(lambda x, fr: add_limited_index(x, fr, "__lsi"), back_rows=wrows(LIMIT_ATR) + 2)
    return series.with_df(d).running({"asi": ("sum", F.col("__lsi"))}).drop("__lsi")


def chaikin_oscillator(series: Series, fast: int = 3, slow: int = 10) -> DataFrame:
    d = accumulation_distribution(series)

    def stage(x, fr):
        x = add_ema(add_ema(x, fr, "__f", F.col("ad_line"), fast), fr, "__s", F.col("ad_line"), slow)
        return x.withColumn("chaikin_oscillator", F.col("__f") - F.col("__s")).drop("__f", "__s")

    return series.with_df(d).map(stage, back_rows=ema_rows(slow) + 1)


def vwap(series: Series) -> DataFrame:
    """Volume-weighted typical price since the start of the UTC day."""
    d = series.df.withColumn("__day", F.date_trunc("day", series.order[0]))
    s = Series(d, [*series.key, "__day"], series.order)
    run = s.running({"__pv": ("sum", typical() * v()), "__vv": ("sum", v())})
    return run.withColumn("vwap", F.when(F.col("__vv") > 0, F.col("__pv") / F.col("__vv"))).drop("__day", "__pv", "__vv")


def _pivots(df: DataFrame, key: str | Sequence[str], levels: dict[str, Column], **more: Column) -> DataFrame:
    d = prev_period_levels(df, key, DAY_US)
    for n, col in more.items():
        d = d.withColumn(n, col)
    return d.select("*", *[x.alias(n) for n, x in levels.items()])


def pivot_points(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    ph, pl, pc = F.col("prev_high"), F.col("prev_low"), F.col("prev_close")
    p = (ph + pl + pc) / 3
    return _pivots(df, key, {
        "pivot": p, "r1": 2 * p - pl, "s1": 2 * p - ph, "r2": p + (ph - pl), "s2": p - (ph - pl),
        "r3": ph + 2 * (p - pl), "s3": pl - 2 * (ph - p),
    })


def woodie_pivots(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    ph, pl, pc = F.col("prev_high"), F.col("prev_low"), F.col("prev_close")
    p = (ph + pl + 2 * pc) / 4
    return _pivots(df, key, {"pivot": p, "r1": 2 * p - pl, "s1": 2 * p - ph, "r2": p + (ph - pl), "s2": p - (ph - pl)})


def camarilla_pivots(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    ph, pl, pc = F.col("prev_high"), F.col("prev_low"), F.col("prev_close")
    out = {}
    for i, div in enumerate((12.0, 6.0, 4.0, 2.0), start=1):  # fixed values: divisors of the 1.1 range share
        out[f"r{i}"] = pc + (ph - pl) * 1.1 / div
        out[f"s{i}"] = pc - (ph - pl) * 1.1 / div
    return _pivots(df, key, out)


SESSION_CUTS = (8, 16)  # fixed values: session 0 before 08h, 1 before 16h, then 2


def session_strength(series: Series) -> DataFrame:
    """Position in the running session range, finished Asian range, London break in Asian ranges."""
    ts = series.order[0]
    hour = F.hour(ts)
    sess = F.when(hour < SESSION_CUTS[0], 0).when(hour < SESSION_CUTS[1], 1).otherwise(2)
    d = series.df.withColumn("session", sess).withColumn("day", F.date_trunc("day", ts))
    run = Series(d, [*series.key, "day", "session"], series.order).running(
        {"__hi": ("max", h()), "__lo": ("min", l())}
    )
    value = F.when(F.col("__hi") > F.col("__lo"), (c() - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 2 - 1)
    done = d.groupBy(*series.key, "day").agg(
        (F.max(F.when(F.col("session") == 0, h())) - F.min(F.when(F.col("session") == 0, l()))).alias("asian_range"),
        F.min_by(F.when(F.col("session") == 1, c()), F.when(F.col("session") == 1, F.col(ts))).alias("__lopen"),
        F.min_by(F.when(F.col("session") == 2, c()), F.when(F.col("session") == 2, F.col(ts))).alias("__nyfirst"),
    )
    j = run.withColumn("session_value", value).join(done, [*series.key, "day"])
    later = F.col("session") >= 1
    broke = (F.col("__nyfirst") - F.col("__lopen")) / F.col("asian_range")
    return (
        j.withColumn("london_break", F.when((F.col("session") == 2) & (F.col("asian_range") > 0), broke))
        .withColumn("asian_range", F.when(later, F.col("asian_range")))
        .drop("__hi", "__lo", "__lopen", "__nyfirst", "day")
    )
