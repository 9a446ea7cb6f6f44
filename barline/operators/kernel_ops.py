"""Kernels that need more than one frame: visits, densities, complexity, consensus, Kalman."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.asof import asof
from barline.operators.indicators.levels import limited_asi
from barline.plans.matrixscan import matrix_scan
from barline.plans.scan import ema_first, lookback
from barline.plans.series import Series, as_list
from barline.sources.sinks import materialize

# fixed values: coarse steps in base bars and the weight log2(step) + 1
CONSENSUS_STEPS = (1, 2, 6, 12, 24, 60, 120, 360, 720)
CONSENSUS_LAGS = 5


def time_since_visit(series: Series, grid: float, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """Bars since an earlier bar's range covered the price bin of this close.

    A range of bins is the union of its canonical dyadic nodes, at most two on each of
    log2(bins) levels; a price looks under the nodes above its bin, one a level.
    """
    d = materialize(series.numbered("__rn"), "numbered")
    key = list(series.key)

    def bin_of(x: str) -> Column:
        return F.floor(F.col(x) / F.lit(grid)).cast("long")

    widest = d.agg(F.max(bin_of(high) - bin_of(low) + 1)).collect()[0][0] or 1
    nodes = F.explode(dyadic_cover(bin_of(low), bin_of(high))).alias("__n")
    visits = d.filter(bin_of(low) <= bin_of(high)).select(*key, F.col("__rn").alias("seen"), nodes).select(*key, "seen", "__n.*")
    above = F.explode(dyadic_ancestors(bin_of(close), int(widest).bit_length())).alias("__n")
    looks = d.select(*key, "__rn", above).select(*key, "__rn", "__n.*")
    found = asof(looks, visits, [*key, "level", "node"], left_ts="__rn", right_ts="seen", strict=True, keep_right_ts="__seen")
    latest = found.groupBy(*key, "__rn").agg(F.max("__seen").alias("__seen"))
    return d.join(latest, [*key, "__rn"], "left").withColumn("bars_since_visit", F.col("__rn") - F.col("__seen")).drop("__rn", "__seen")


def dyadic_cover(low: Column, high: Column) -> Column:
    """Array of (level, node): the fewest dyadic intervals [node, node + 1) * 2**level whose
    union is the whole numbers from ``low`` to ``high``."""

    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, stop = F.ceil(low / width).cast("long"), F.floor((high + 1) / width).cast("long")
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        left = F.when((first < stop) & (F.pmod(first, F.lit(2)) == 1), node(first))
        right = F.when((first < stop) & (F.pmod(stop, F.lit(2)) == 1), node(stop - 1))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.ceil(F.log2((high - low + 2).cast("double"))).cast("int"))
    return F.array_compact(F.flatten(F.transform(levels, at)))


def dyadic_ancestors(value: Column, levels: int) -> Column:
    """Array of the (level, node) that hold a whole number, ``levels`` up."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(value / F.lit(1 << k)).cast("long").alias("node")) for k in range(levels + 1)])


def level_density(events: DataFrame, key: str | Sequence[str], bin_size: float, half_life_days: float, ts: str = "ts", price: str = "value") -> DataFrame:
    """Decay-weighted count of price events per bin, seen from the last event of each key.

    Decay factors multiply, so weights are summed per (key, bin) against a fixed
    origin by one partial aggregate and rescaled once.
    """
    keys = as_list(key)
    rate = math.log(2.0) / (half_life_days * 86_400e6)
    last = events.groupBy(*keys).agg(F.max(F.unix_micros(ts)).alias("__now"))
    bins = (
        events.join(last, keys)
        .withColumn("__age", F.greatest(F.col("__now") - F.unix_micros(ts), F.lit(60_000_000)).cast("double"))
        .groupBy(*keys, F.floor(F.col(price) / bin_size).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.exp(-F.col("__age") * rate)).alias("weight"),
            F.sum(86_400e6 / F.col("__age")).alias("inverse_age"),
        )
    )
    stats = bins.groupBy(*keys).agg(F.avg("weight").alias("__m"), F.stddev_pop("weight").alias("__s"))
    return bins.join(stats, keys).withColumn(
        "z", F.when(F.col("__s") > 0, (F.col("weight") - F.col("__m")) / F.col("__s"))
    ).drop("__m", "__s")


def density_at(rows: DataFrame, events: DataFrame, key: str | Sequence[str], bin_size: float, half_life_days: float, known: str, price: str = "close") -> DataFrame:
    """Causal density of past events in the bin of each row's price.

    The decayed count of a (key, bin) follows y = decay * y + 1, an affine scan
    over its events; each row then looks its bin up as of its own time.
    """
    from barline.plans.scan import affine

    keys = as_list(key)
    rate = math.log(2.0) / (half_life_days * 86_400e6)
    ev = events.filter(F.col(known).isNotNull()).select(
        *keys, F.floor(F.col("value") / bin_size).alias("__bin"), F.col(known).alias("available_at"))
    # events of one instant and bin count together
    ev = ev.groupBy(*keys, "__bin", "available_at").agg(F.count(F.lit(1)).alias("__n"))

    def stage(d, fr):
        dt = F.unix_micros("available_at") - F.lag(F.unix_micros("available_at")).over(fr.w())
        d = d.withColumn("__a", F.coalesce(F.exp(-dt * rate), F.lit(0.0)))
        return affine(d, fr, "density", F.col("__a"), F.col("__n"))

    # events further apart than the decay can see do not matter, so a time halo is enough
    scanned = Series(ev, [*keys, "__bin"], ["available_at"]).map(stage, back_us=int(40.0 / rate)).drop("__a", "__n")
    left = rows.withColumn("__bin", F.floor(F.col(price) / bin_size))
    j = asof(left, scanned, [*keys, "__bin"], keep_right_ts="__at")
    age = (F.unix_micros("ts") - F.unix_micros("__at")).cast("double")
    return j.withColumn("density", F.coalesce(F.col("density") * F.exp(-age * rate), F.lit(0.0))).drop("__bin", "__at")


# ----- complexity of sampled windows -------------------------------------------


def permutation_entropy(x: np.ndarray, m: int = 3) -> float:
    """Normalised entropy of ordinal patterns of length m."""
    if len(x) < m + 1:
        return math.nan
    view = np.lib.stride_tricks.sliding_window_view(x, m)
    codes = np.argsort(view, axis=1, kind="stable") @ (m ** np.arange(m))
    _, n = np.unique(codes, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum() / math.log2(math.factorial(m)))


def higuchi_dimension(x: np.ndarray, k_max: int = 8) -> float:
    """Slope of log curve length against log scale, clipped to [1, 2]."""
    n = len(x)
    pts = []
    for k in range(1, k_max + 1):
        lengths = []
        for m in range(k):
            part = x[m::k]
            steps = len(part) - 1
            if steps >= 1:
                lengths.append(np.abs(np.diff(part)).sum() * (n - 1) / (steps * k * k))
        mean = float(np.mean(lengths)) if lengths else 0.0
        if mean > 0:
            pts.append((-math.log(k), math.log(mean)))
    if len(pts) < 2:
        return math.nan
    a = np.array(pts)
    dx = a[:, 0] - a[:, 0].mean()
    return float(np.clip((dx * (a[:, 1] - a[:, 1].mean())).sum() / (dx * dx).sum(), 1.0, 2.0))


def rescaled_range(x: np.ndarray) -> float:
    """Hurst-style exponent log(R/S) / log(n) of one window."""
    d = np.diff(x)
    s = d.std()
    if len(d) < 8 or s == 0:
        return math.nan
    z = np.cumsum(d - d.mean())
    return float(math.log((z.max() - z.min()) / s) / math.log(len(d)))


def complexity(series: Series, col: str, window: int, step: int) -> DataFrame:
    """Complexity measures of the last ``window`` rows at every ``step``-th row.

    Each row is sent to the few sampled windows that contain it, so a group is
    one window, never a key.
    """
    key, order = list(series.key), list(series.order)
    d = series.numbered("__rn").select(*key, *order, F.col(col).cast("double").alias("__x"), "__rn")
    first_end = F.ceil(F.col("__rn") / step) * step
    ends = F.filter(
        F.sequence(first_end, first_end + window, F.lit(step).cast("long")),
        lambda e: (e - window < F.col("__rn")) & (e >= window),
    )
    rows = d.withColumn("__end", F.explode(ends))
    win = rows.groupBy(*key, "__end").agg(
        F.array_sort(F.collect_list(F.struct("__rn", "__x"))).alias("__w"),
        F.max_by(F.struct(*order), "__rn").alias("__o"),
        F.max("__rn").alias("__last"),
    ).filter(F.col("__last") == F.col("__end"))

    @F.pandas_udf("perm_entropy double, higuchi double, rescaled double")
    def measures(arrays: pd.Series) -> pd.DataFrame:
        out = [(permutation_entropy(a), higuchi_dimension(a), rescaled_range(a)) for a in (np.asarray(v, dtype=float) for v in arrays)]
        return pd.DataFrame(out, columns=["perm_entropy", "higuchi", "rescaled"])

    xs = F.transform("__w", lambda s: s["__x"])
    return win.select(*key, "__o.*", measures(xs).alias("__m")).select(*key, *order, "__m.*")


# ----- multi-step consensus -------------------------------------------------------


def price_consensus(series: Series, col: str = "close", steps: Sequence[int] = CONSENSUS_STEPS, lags: int = CONSENSUS_LAGS, warmup: int = 100) -> DataFrame:
    """Share of same-signed changes of EMA3-EMA5 over coarse samplings of ``col``.

    At each step the last ``lags + 2`` completed samples feed the two short means,
    started on the oldest of them; steps are averaged with weight log2(step)+1.
    """
    need = lags + 2
    d = series.numbered("__rn")

    def stage(x: DataFrame, fr) -> DataFrame:
        names = {}
        for s in steps:
            samples = F.array(*[F.lag(col, s * i).over(fr.w()) for i in reversed(range(need))])
            x = x.withColumn(f"__s{s}", F.when(F.col("__rn") % s == 0, samples))
        x = x.select("*", *[F.last(f"__s{s}", ignorenulls=True).over(fr.rows(-(s - 1), 0)).alias(f"__v{s}") for s in steps])
        for s in steps:
            arr = F.col(f"__v{s}")
            run = F.aggregate(
                F.slice(arr, 1, need),
                F.struct(arr[0].alias("a"), arr[0].alias("b"), F.array().cast("array<double>").alias("d")),
                lambda acc, p: F.struct(
                    (0.5 * p + 0.5 * acc["a"]).alias("a"), (p / 3.0 + acc["b"] * (2.0 / 3.0)).alias("b"),
                    F.array_append(acc["d"], (0.5 * p + 0.5 * acc["a"]) - (p / 3.0 + acc["b"] * (2.0 / 3.0))).alias("d"),
                ),
            )["d"]
            x = x.withColumn(f"__d{s}", run)
            names[s] = F.col(f"__d{s}")
        top, top2, weight = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for s in steps:
            ok = F.col("__rn") >= s * need
            wt = math.log2(s) + 1.0
            d1 = [names[s][need - 1 - i] - names[s][need - 2 - i] for i in range(lags + 1)]
            first = sum((F.signum(v) for v in d1[:lags]), F.lit(0.0)) / lags
            second = sum((F.signum(d1[i] - d1[i + 1]) for i in range(lags)), F.lit(0.0)) / lags
            top = top + F.when(ok, wt * first).otherwise(0.0)
            top2 = top2 + F.when(ok, wt * second).otherwise(0.0)
            weight = weight + F.when(ok, F.lit(wt)).otherwise(0.0)
        live = F.col("__rn") >= warmup
        x = x.withColumn("mc_d", F.when(live, top / weight)).withColumn("mc_dd", F.when(live, top2 / weight))
        return x.drop(*[f"__{p}{s}" for p in "svd" for s in steps])

    return series.with_df(d).map(stage, back_rows=need * max(steps) + 2).drop("__rn")


def asi_consensus(series: Series, steps: Sequence[int] = CONSENSUS_STEPS, lags: int = CONSENSUS_LAGS, smooth: int = 5) -> DataFrame:
    """Consensus on the smoothed accumulated swing index, completed coarse bars only.

    Every row that ends a coarse bar is exploded to the steps it ends; each
    (key, step) is a series of its own, scanned in parallel.
    """
    key, order = list(series.key), list(series.order)
    base = series.with_df(limited_asi(series))
    smoothed = base.map(lambda x, fr: x.withColumn("__x", F.avg("asi").over(fr.last_n(smooth))), back_rows=smooth)
    d = series.with_df(smoothed).numbered("__rn")
    ends = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: F.col("__rn") % s == 0)
    coarse = d.select(*key, *order, "__x", "__rn", F.explode(ends).alias("step")).withColumn(
        "__ci", F.floor(F.col("__rn") / F.col("step")))
    cs = Series(coarse, [*key, "step"], order)

    def stage(x, fr):
        x = ema_first(x, fr, "__e3", F.col("__x"), 0.5)
        x = ema_first(x, fr, "__e5", F.col("__x"), 1.0 / 3.0)
        x = x.withColumn("__d", F.col("__e3") - F.col("__e5"))
        x = x.withColumn("__d1", F.col("__d") - F.lag("__d").over(fr.w()))
        x = x.withColumn("__d2", F.col("__d1") - F.lag("__d1").over(fr.w()))
        x = x.withColumn("__d3", F.col("__d2") - F.lag("__d2").over(fr.w()))
        w = fr.last_n(lags)
        return x.withColumn("__c1", F.sum(F.signum("__d1")).over(w) / lags).withColumn("__c2", F.sum(F.signum("__d3")).over(w) / lags)

    done = cs.map(stage, back_rows=lookback(2.0 / 3.0) + lags + 5)
    ok = F.col("__ci") >= lags + 5
    cells = done.filter(ok).groupBy(*key, *order).agg(
        *[F.max(F.when(F.col("step") == s, F.struct("__c1", "__c2"))).alias(f"__k{s}") for s in steps])
    j = d.join(cells, [*key, *order], "left")
    filled = series.with_df(j).running({f"__f{s}": ("last", F.col(f"__k{s}")) for s in steps})
    weight = {s: F.when(F.col(f"__f{s}").isNotNull(), F.lit(math.log2(s) + 1.0)).otherwise(0.0) for s in steps}
    total = sum(weight.values(), F.lit(0.0))

    def mix(field):
        return F.when(total > 0, sum((weight[s] * F.coalesce(F.col(f"__f{s}.{field}"), F.lit(0.0)) for s in steps), F.lit(0.0)) / total)

    return filled.select(*series.df.columns, F.col("__x").alias("asi_smooth"), mix("__c1").alias("asi_mc_d"), mix("__c2").alias("asi_mc_dd"))


# ----- entity strengths from pair returns ---------------------------------------------


def kalman_gains(h: np.ndarray, q: float, r: float, p0: float = 0.01, limit: int = 5000) -> list[np.ndarray]:
    """Gain sequence of the filter; it does not depend on data and settles."""
    n = h.shape[1]
    p = np.eye(n) * p0
    gains: list[np.ndarray] = []
    for _ in range(limit):
        p = p + np.eye(n) * q
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.eye(h.shape[0]) * r)
        p = (np.eye(n) - k @ h) @ p
        if gains and np.abs(k - gains[-1]).max() < 1e-14:
            break
        gains.append(k)
    return gains


def kalman_strength(panel: DataFrame, ts: str, legs: dict[str, tuple[str, str]], q: float = 1e-5, r: float = 1e-3) -> DataFrame:
    """Zero-mean entity strengths from pair log returns.

    ``panel`` holds one close column per pair; ``legs`` maps it to (base, quote).
    With gains known in advance the filter is a vector recurrence with matrices that
    depend on the row number alone, scanned in blocks.
    """
    pairs = sorted(legs)
    entities = sorted({e for legs_ in legs.values() for e in legs_})
    h = np.zeros((len(pairs), len(entities)))
    for i, p in enumerate(pairs):
        h[i, entities.index(legs[p][0])] += 1.0
        h[i, entities.index(legs[p][1])] -= 1.0
    n = len(entities)
    centre = np.eye(n) - 1.0 / n
    pull = centre @ np.stack(kalman_gains(h, q, r))
    keep = centre - pull @ h
    names = [f"__y{i}" for i in range(len(pairs))]

    def terms(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(cols["__rn"].astype(int) - 1, len(pull) - 1)
        y = np.nan_to_num(np.stack([cols[c] for c in names], axis=1))
        return keep[at], (pull[at] @ y[:, :, None])[:, :, 0]

    returns = Series(panel, None, [ts]).columns(
        lambda fr: {f"__y{i}": F.log(F.col(p) / F.lag(p).over(fr.w())) for i, p in enumerate(pairs)}, back_rows=1
    ).filter(F.col("__y0").isNotNull())
    series = Series(returns, None, [ts])
    return matrix_scan(series.with_df(series.numbered("__rn")), [*names, "__rn"], entities, terms, [0.0] * n)
