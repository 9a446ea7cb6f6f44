"""What happened after (or before) an event, read from the bars on its path.

All of these join events to bars by time bucket and reduce each event with
partial aggregates, so no event, key or path is walked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import HOUR_US, shift
from barline.operators import windows as W
from barline.operators.asof import asof
from barline.operators.joins import backward_path, path
from barline.plans.matrixscan import matrix_fold
from barline.plans.orderstats import robust_zscores
from barline.plans.series import Frame, Series, as_list


def forward_return(series: Series, h: int, cost: float | Column = 0.0, price: str = "close") -> DataFrame:
    """Move over the next h bars minus a round-trip cost."""
    c = F.lit(cost) if isinstance(cost, (int, float)) else cost
    return series.columns(lambda fr: {f"fwd_{h}": F.lead(price, h).over(fr.w()) - F.col(price) - c}, fwd_rows=h)


def _gain(side: Column, high: Column, low: Column, entry: Column) -> tuple[Column, Column]:
    best = F.when(side > 0, high - entry).otherwise(entry - low)
    worst = F.when(side > 0, low - entry).otherwise(entry - high)
    return best, worst


def first_passage(events: DataFrame, bars: DataFrame, key, up: float, down: float, horizon_us: int, ids: Sequence[str]) -> DataFrame:
    """Triple-barrier label: stop (-1) before target (+1) inside one bar, 0 at timeout.

    ``events`` has event_ts, entry, side.  Every bar of the path offers at most
    one candidate (time, priority); the event takes the smallest.
    """
    p = path(events, bars.select(*as_list(key), "ts", "high", "low", "close"), key, horizon_us, include_start=False)
    best, worst = _gain(F.col("side"), F.col("high"), F.col("low"), F.col("entry"))
    hit = (
        F.when(worst <= -down, F.struct(F.col("ts").alias("at"), F.lit(0).alias("pri"), F.lit(-1).alias("label"), F.lit(-down).alias("pnl")))
        .when(best >= up, F.struct(F.col("ts").alias("at"), F.lit(1).alias("pri"), F.lit(1).alias("label"), F.lit(up).alias("pnl")))
    )
    g = p.groupBy(*as_list(key), *ids).agg(
        F.min(hit).alias("__h"),
        F.max_by((F.col("close") - F.col("entry")) * F.col("side"), "ts").alias("__last"),
        F.max("ts").alias("__end"),
    )
    exit_ts = F.coalesce(F.col("__h.at"), F.col("__end"))
    out = g.select(
        *as_list(key), *ids, F.coalesce(F.col("__h.label"), F.lit(0)).alias("label"),
        F.coalesce(F.col("__h.pnl"), F.col("__last")).alias("exit_pnl"), exit_ts.alias("exit_ts"))
    # excursions and bars held count only up to the exit
    j = p.join(out.select(*as_list(key), *ids, "exit_ts"), [*as_list(key), *ids]).filter(F.col("ts") <= F.col("exit_ts"))
    ex = j.groupBy(*as_list(key), *ids).agg(F.max(best).alias("mfe"), F.min(worst).alias("mae"), F.count(F.lit(1)).alias("bars_held"))
    return out.join(ex, [*as_list(key), *ids])


def excursions(events: DataFrame, bars: DataFrame, key, horizons_us: dict[str, int], ids: Sequence[str]) -> DataFrame:
    """Best and worst excursion within several horizons from one path join."""
    p = path(events, bars.select(*as_list(key), "ts", "high", "low"), key, max(horizons_us.values()), include_start=False)
    best, worst = _gain(F.col("side"), F.col("high"), F.col("low"), F.col("entry"))
    age = F.unix_micros("ts") - F.unix_micros("event_ts")
    aggs = []
    for name, h in horizons_us.items():
        aggs += [F.max(F.when(age <= h, best)).alias(f"mfe_{name}"), F.min(F.when(age <= h, worst)).alias(f"mae_{name}")]
    return p.groupBy(*as_list(key), *ids).agg(*aggs)


def underwater(events: DataFrame, bars: DataFrame, key, horizon_us: int, lam: float, bar_minutes: float, ids: Sequence[str]) -> DataFrame:
    """Final move minus lam times the area spent below entry."""
    p = path(events, bars.select(*as_list(key), "ts", "close"), key, horizon_us, include_start=False)
    u = (F.col("close") - F.col("entry")) * F.col("side")
    return p.groupBy(*as_list(key), *ids).agg(
        F.max_by(u, "ts").alias("pnl"), (F.sum(F.greatest(-u, F.lit(0.0))) * bar_minutes).alias("area")
    ).withColumn("score", F.col("pnl") - lam * F.col("area"))


def checkpoint_mfe(events: DataFrame, bars: DataFrame, key, hours: Sequence[float], ids: Sequence[str]) -> DataFrame:
    """Best excursion by each checkpoint beside the result at the last one."""
    names = {f"{str(h).replace('.', 'p')}h": int(h * HOUR_US) for h in hours}
    ex = excursions(events, bars, key, names, ids)
    p = path(events, bars.select(*as_list(key), "ts", "close"), key, max(names.values()), include_start=False)
    final = p.groupBy(*as_list(key), *ids).agg(F.max_by((F.col("close") - F.col("entry")) * F.col("side"), "ts").alias("final"))
    return ex.select(*as_list(key), *ids, *[f"mfe_{n}" for n in names]).join(final, [*as_list(key), *ids])


def event_profile(events: DataFrame, bars: DataFrame, key, metric: str, k: int, width_us: int) -> DataFrame:
    """Mean metric at bar offsets -k..k around events (offsets counted in whole bar widths)."""
    ev = events.select(*as_list(key), "event_ts", shift("event_ts", -k * width_us).alias("__from"))
    rows = bars.select(*as_list(key), "ts", F.col(metric).alias("__x"))
    p = path(ev, rows, key, 2 * k * width_us, event_ts="__from")
    off = F.round((F.unix_micros("ts") - F.unix_micros("event_ts")) / width_us).cast("int")
    return p.groupBy(off.alias("offset")).agg(F.avg("__x").alias("mean"), F.count("__x").alias("n"))


def lift(series: Series, src: Column, tgt: Column, lags: Sequence[int]) -> DataFrame:
    """P(target at t+lag | source at t) / P(target), every lag in one pass."""
    d = series.df.withColumn("__s", F.coalesce(src, F.lit(False)).cast("double")).withColumn("__t", F.coalesce(tgt, F.lit(False)).cast("double"))
    s = series.with_df(d)
    d = s.columns(lambda fr: {f"__t{k}": F.lead("__t", k).over(fr.w()) for k in lags}, fwd_rows=max(lags))
    row = d.agg(F.avg("__t").alias("__base"), *[F.avg(F.when(F.col("__s") == 1, F.col(f"__t{k}"))).alias(f"__r{k}") for k in lags])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__r{k}").alias("rate")) for k in lags])
    return row.select("__base", F.explode(cells).alias("x")).select(
        "x.lag", "x.rate", F.col("__base").alias("base_rate"), F.when(F.col("__base") > 0, F.col("x.rate") / F.col("__base")).alias("lift"))


def propagation(fine: DataFrame, coarse: Series, flag: str, coarse_flag: str, width_us: int, lags: Sequence[int]) -> DataFrame:
    """Rate of a coarse event at each lag given any fine event inside the coarse bar."""
    from barline.functions.clock import floor_ts

    keys = list(coarse.key)
    any_fine = fine.groupBy(*keys, floor_ts("ts", width_us).alias("ts")).agg(F.bool_or(F.col(flag)).cast("int").alias("__any"))
    d = coarse.df.join(any_fine, [*keys, "ts"], "left").withColumn("__any", F.coalesce("__any", F.lit(0))).withColumn("__c", F.col(coarse_flag).cast("double"))
    s = coarse.with_df(d)

    def cols(fr: Frame):
        return {f"__c{i}": (F.lead("__c", k) if k >= 0 else F.lag("__c", -k)).over(fr.w()) for i, k in enumerate(lags)}

    d = s.columns(cols, back_rows=max(-min(lags), 0), fwd_rows=max(max(lags), 0))
    row = d.agg(*[F.avg(F.when(F.col("__any") == 1, F.col(f"__c{i}"))).alias(f"r{i}") for i in range(len(lags))],
                *[F.avg(F.when(F.col("__any") == 0, F.col(f"__c{i}"))).alias(f"q{i}") for i in range(len(lags))])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{i}").alias("rate_with"), F.col(f"q{i}").alias("rate_without")) for i, k in enumerate(lags)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def next_window_targets(series: Series, horizon_us: int, scale: str) -> DataFrame:
    """Best and worst move of the next window in units of a causal scale column."""
    d = series.columns(lambda fr: W.forward_extremes(fr, horizon_us), fwd_us=horizon_us)
    ok = (F.col("fwd_rows") > 0) & (F.col(scale) > 0)
    return d.withColumn("up_units", F.when(ok, (F.col("fwd_high") - F.col("close")) / F.col(scale))).withColumn(
        "down_units", F.when(ok, (F.col("close") - F.col("fwd_low")) / F.col(scale)))


def prior_run(events: DataFrame, bars: DataFrame, key, horizon_us: int, ids: Sequence[str]) -> DataFrame:
    """Slope, efficiency and length of the path that led into each event."""
    steps = Series(bars, key, ["ts"]).columns(lambda fr: {"__step": F.abs(F.col("close") - F.lag("close").over(fr.w()))}, back_rows=1)
    p = backward_path(events, steps.select(*as_list(key), "ts", "close", "__step"), key, horizon_us)
    hours = (F.unix_micros("ts") - F.unix_micros("event_ts")) / float(HOUR_US)
    first_ts = F.min(F.struct("ts", "close", "__step"))
    g = p.groupBy(*as_list(key), *ids).agg(
        F.regr_slope(F.col("close"), hours).alias("slope"), F.count(F.lit(1)).alias("length"),
        F.sum("__step").alias("__path"), first_ts.alias("__a"), F.max_by("close", "ts").alias("__z"))
    inner = F.col("__path") - F.coalesce(F.col("__a.__step"), F.lit(0.0))
    return g.select(*as_list(key), *ids, "slope", "length", F.when(inner > 0, F.abs(F.col("__z") - F.col("__a.close")) / inner).alias("efficiency"))


def level_strength(events: DataFrame, levels: DataFrame, key, tol: float, tau_us: float, known: str, ids: Sequence[str]) -> DataFrame:
    """Strength of the level at each event's price: earlier levels near it, weighted by recency.

    The price axis is cut into bins of ``tol``; a level is looked for in the
    event's bin and its two neighbours, then tested exactly.
    """
    keys = as_list(key)
    lv = levels.filter(F.col(known).isNotNull()).select(*keys, F.col(known).alias("__k"), F.col("value").alias("__v"), F.floor(F.col("value") / tol).alias("__b"))
    ev = events.withColumn("__c", F.floor(F.col("entry") / tol)).withColumn("__b", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1)))
    near = (F.abs(F.col("__v") - F.col("entry")) <= tol) & (F.col("__k") <= F.col("event_ts"))
    w = F.exp(-(F.unix_micros("event_ts") - F.unix_micros("__k")) / F.lit(float(tau_us)))
    hits = ev.join(lv, [*keys, "__b"]).filter(near).groupBy(*keys, *ids).agg(F.sum(w).alias("__w"), F.count(F.lit(1)).alias("__n"))
    return events.join(hits, [*keys, *ids], "left").select(
        *keys, *ids, F.coalesce("__w", F.lit(0.0)).alias("strength"), F.coalesce("__n", F.lit(0)).alias("n_levels"))


def coactivation(series: Series, price: str, levels: Sequence[int], n: int, threshold: float) -> DataFrame:
    """Number of wavelet bands whose trailing robust z passes the threshold."""

    def stage(d: DataFrame, fr: Frame) -> DataFrame:
        d = d.select("*", *[F.abs(W.haar(fr, F.col(price), k)).alias(f"__h{k}") for k in levels])
        d = robust_zscores(d, fr, {f"__z{k}": f"__h{k}" for k in levels}, n)
        count = sum((F.coalesce((F.col(f"__z{k}") > threshold).cast("int"), F.lit(0)) for k in levels), F.lit(0))
        return d.withColumn("n_active", count).drop(*[f"__h{k}" for k in levels], *[f"__z{k}" for k in levels])

    return series.map(stage, back_rows=2 ** max(levels) + n + 1)


def ceiling(series: Series, price: str, cost: float) -> DataFrame:
    """Best total of non-overlapping long/short segments with perfect foresight, net of cost.

    With the states flat, long and short a bar is a 3x3 max-plus matrix: the best total
    in each state follows from those before it. Matrices are folded per block and the
    blocks of a key in a tree.
    """
    turn = np.array([[0.0, cost, cost], [0.0, 0.0, cost], [0.0, cost, 0.0]])

    def terms(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = cols["__d"]
        gain = np.stack((np.zeros_like(x), x, -x), axis=1)
        return gain[:, :, None] - turn.T, np.full((len(x), 3), -np.inf)

    d = series.columns(lambda fr: {"__d": F.col(price) - F.lag(price).over(fr.w())}, back_rows=1)
    steps = series.with_df(d.filter(F.col("__d").isNotNull()))
    best = matrix_fold(steps, ["__d"], ["__flat", "__long", "__short"], terms, [0.0, -np.inf, -np.inf], "max")
    return best.select(*series.key, F.greatest("__flat", "__long", "__short").alias("ceiling"))


def outcome_by(events: DataFrame, bars: DataFrame, key, at: str) -> DataFrame:
    """Last bar known at each event, for entry prices."""
    right = bars.select(*as_list(key), "available_at", F.col("close").alias("entry"))
    return asof(events, right, key, left_ts=at)
