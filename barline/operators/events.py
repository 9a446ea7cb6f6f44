"""Event detection: shocks, spikes, crosses, patterns, episodes, alignment, hysteresis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import floor_ts
from barline.functions.shape import true_range
from barline.operators import kernels as K
from barline.operators import windows as W
from barline.operators.asof import asof
from barline.operators.indicators.special import swings
from barline.plans.orderstats import robust_zscores
from barline.plans.sequential import run_kernel
from barline.plans.series import Frame, Series, as_list

swing_table = swings


def islands(series: Series, state: str, run: str = "run") -> DataFrame:
    """Number the runs of equal ``state`` per key."""
    flagged = series.columns(
        lambda fr: {"__brk": F.when(F.col(state).eqNullSafe(F.lag(state).over(fr.w())) & F.lag(F.lit(1)).over(fr.w()).isNotNull(), 0).otherwise(1)},
        back_rows=1,
    )
    return series.with_df(flagged).running({run: ("sum", F.col("__brk"))})


def streaks(series: Series, state: str) -> DataFrame:
    """Run number and length so far of the current run."""
    d = series.with_df(islands(series, state)).numbered("__rn")
    d = series.with_df(d).running({"__start": ("last", F.when(F.col("__brk") == 1, F.col("__rn")))})
    return d.withColumn("len", F.col("__rn") - F.col("__start") + 1).drop("__brk", "__rn", "__start")


def big_bars(series: Series, k: float = 3.0, n: int | None = None) -> DataFrame:
    """True range at least mean + k*std: over the whole series, or over the previous n bars."""
    d = series.map(lambda x, fr: x.withColumn("tr", true_range(fr)), back_rows=1)
    s = series.with_df(d)
    if n is None:
        stats = d.groupBy(*series.key).agg(F.avg("tr").alias("__m"), F.stddev_pop("tr").alias("__s"))
        d = d.join(stats, list(series.key))
    else:
        d = s.columns(lambda fr: {"__m": F.avg("tr").over(fr.rows(-n, -1)), "__s": F.stddev_pop("tr").over(fr.rows(-n, -1)),
                                  "__n": F.count("tr").over(fr.rows(-n, -1))}, back_rows=n)
        d = d.withColumn("__m", F.when(F.col("__n") == n, F.col("__m"))).drop("__n")
    return d.withColumn("is_big", F.coalesce((F.col("tr") >= F.col("__m") + k * F.col("__s")).cast("int"), F.lit(0))).drop("__m", "__s")


def momentum_stack(series: Series, windows: Sequence[int], sigma_rows: int = 60, price: str = "close") -> DataFrame:
    """Net move per bar over several windows, scaled by its own trailing deviation, and acceleration."""

    def stage(d: DataFrame, fr: Frame) -> DataFrame:
        d = d.select("*", *[(W.diff(fr, F.col(price), w) / w).alias(f"mom_{w}") for w in windows])
        d = d.select("*", *[W.roll(fr, F.col(f"mom_{w}"), sigma_rows, "std").alias(f"__sd_{w}") for w in windows])
        d = d.select("*", *[F.when(F.col(f"__sd_{w}") > 0, F.col(f"mom_{w}") / F.col(f"__sd_{w}")).alias(f"norm_{w}") for w in windows],
                     *[W.diff(fr, F.col(f"mom_{w}")).alias(f"acc_{w}") for w in windows])
        return d.drop(*[f"__sd_{w}" for w in windows])

    return series.map(stage, back_rows=max(windows) + sigma_rows + 1)


def edge(fr: Frame, flag: Column, name: str, d: DataFrame) -> DataFrame:
    """True on the first row of a true run."""
    d = d.withColumn("__f", F.coalesce(flag, F.lit(False)))
    return d.withColumn(name, F.col("__f") & ~F.coalesce(F.lag("__f").over(fr.w()), F.lit(False))).drop("__f")


def thin(events: DataFrame, key: str | Sequence[str], order: Sequence[str], min_gap_us: int) -> DataFrame:
    """Drop events closer than the gap to the last kept one."""
    d = events.withColumn("at", F.unix_micros(order[0]).cast("double"))
    kept = run_kernel(Series(d, key, list(order)), K.min_gap(float(min_gap_us)))
    return events.join(kept.drop("kept"), [*as_list(key), *order], "left_semi")


def thin_simple(series: Series, min_gap_us: int) -> DataFrame:
    """Drop events closer than the gap to the previous event, kept or not."""
    ts = series.order[0]
    d = series.columns(lambda fr: {"__p": F.lag(ts).over(fr.w())}, back_rows=1)
    gap = F.unix_micros(ts) - F.unix_micros("__p")
    return d.filter(gap.isNull() | (gap >= min_gap_us)).drop("__p")


def cross(fr: Frame, a: Column, b: Column) -> Column:
    """+1 when a crosses above b, -1 below, else 0 (a and b are plain columns)."""
    pa, pb = F.lag(a).over(fr.w()), F.lag(b).over(fr.w())
    return F.when((pa <= pb) & (a > b), 1).when((pa >= pb) & (a < b), -1).otherwise(0)


def reentry(fr: Frame, upper: str, lower: str) -> Column:
    """Previous bar fully outside a band and the current one touching it: fade direction."""
    w = fr.w()
    above = (F.lag("low").over(w) > F.lag(upper).over(w)) & (F.col("low") <= F.col(upper))
    below = (F.lag("high").over(w) < F.lag(lower).over(w)) & (F.col("high") >= F.col(lower))
    return F.when(above, -1).when(below, 1).otherwise(0)


def breakout(fr: Frame, n: int) -> Column:
    ch = W.channel(fr, n)
    return F.when(F.col("close") > ch["chan_high"], 1).when(F.col("close") < ch["chan_low"], -1).otherwise(0)


def lag_pattern(fr: Frame, x: str, lags: Sequence[int], threshold: float) -> Column:
    """All listed lags on the same side of the threshold while the current value is on the other."""
    past = [F.lag(x, k).over(fr.w()) for k in lags]
    up = F.col(x) > threshold
    dn = F.col(x) < -threshold
    for p in past:
        up = up & (p < 0)
        dn = dn & (p > 0)
    return F.when(up, 1).when(dn, -1).otherwise(0)


def touches(fr: Frame, level: Column, n: int, eps: float, col: str = "high") -> Column:
    """Earlier rows among the previous n whose ``col`` lies within eps of the current level."""
    arr = F.collect_list(col).over(fr.rows(-n, -1))
    return F.size(F.filter(arr, lambda v: F.abs(v - level) <= eps))


def lag_agreement(fr: Frame, x: str, lags: Sequence[int]) -> Column:
    moves = [F.signum(F.col(x) - F.lag(x, k).over(fr.w())) for k in lags]
    total = sum(moves, F.lit(0.0))
    return F.when(total == len(lags), 1).when(total == -len(lags), -1).when(total.isNotNull(), 0)


def stack_alignment(series: Series, periods: Sequence[int] = (10, 20, 50), closes: int = 3, price: str = "close") -> DataFrame:
    """Price and means stacked in order, all slopes and the last closes monotone; first bar only."""

    def stage(d: DataFrame, fr: Frame) -> DataFrame:
        d = d.select("*", *[W.roll(fr, F.col(price), p, "mean").alias(f"__m{p}") for p in periods])
        ms = [F.col(f"__m{p}") for p in periods]
        chain_up, chain_dn = F.col(price) > ms[0], F.col(price) < ms[0]
        for a, b in zip(ms, ms[1:]):
            chain_up, chain_dn = chain_up & (a > b), chain_dn & (a < b)
        for p in periods:
            prev = F.lag(f"__m{p}").over(fr.w())
            chain_up, chain_dn = chain_up & (F.col(f"__m{p}") > prev), chain_dn & (F.col(f"__m{p}") < prev)
        for k in range(closes - 1):
            a = F.col(price) if k == 0 else F.lag(price, k).over(fr.w())
            b = F.lag(price, k + 1).over(fr.w())
            chain_up, chain_dn = chain_up & (a > b), chain_dn & (a < b)
        d = d.withColumn("aligned", F.when(chain_up, 1).when(chain_dn, -1).otherwise(0))
        prev = F.coalesce(F.lag("aligned").over(fr.w()), F.lit(0))
        return d.withColumn("stack_signal", F.when(F.col("aligned") != prev, F.col("aligned")).otherwise(0)).drop(
            *[f"__m{p}" for p in periods])

    return series.map(stage, back_rows=max(periods) + closes + 2)


def alignment_score(series: Series, grains: dict[str, str]) -> DataFrame:
    """Sum over calendar grains of the sign of the last completed bar."""
    key, ts = list(series.key), series.order[0]
    d = series.df
    total = F.lit(0)
    for name, unit in grains.items():
        start = F.date_trunc(unit, ts)
        bars = series.df.groupBy(*key, start.alias("__b")).agg(
            F.signum(F.max_by("close", ts) - F.min_by("open", ts)).alias(f"dir_{name}")
        ).select(*key, F.timestamp_add(unit.upper(), F.lit(1), F.col("__b")).alias("available_at"), f"dir_{name}")
        d = asof(d, bars, key, left_ts=ts)
        total = total + F.coalesce(F.col(f"dir_{name}"), F.lit(0)).cast("int")
    return d.withColumn("score", total)


def hysteresis(series: Series, state: str, n: int) -> DataFrame:
    """Held state that changes only after n rows in a row disagree with it."""
    key, order = list(series.key), list(series.order)
    runs = islands(series, state)
    short = runs.groupBy(*key, "run").agg(
        *[F.min_by(o, F.struct(*order)).alias(o) for o in order],
        F.first(F.col(state).cast("double")).alias("raw"), F.count(F.lit(1)).cast("double").alias("length"))
    held = run_kernel(Series(short, key, order), K.hysteresis(n))
    j = runs.join(held.join(short.select(*key, *order, "run", "raw"), [*key, *order]).drop(*order), [*key, "run"])
    pos = series.with_df(runs).numbered("__rn")
    first = series.with_df(pos).running({"__start": ("last", F.when(F.col("__brk") == 1, F.col("__rn")))}).select(
        *key, *order, (F.col("__rn") - F.col("__start")).alias("__off"))
    out = j.join(first, [*key, *order])
    return out.withColumn(
        "held_state", F.when((F.col("flip_at") >= 0) & (F.col("__off") >= F.col("flip_at")), F.col("raw")).otherwise(F.col("held"))
    ).drop("run", "__brk", "held", "flip_at", "raw", "__off")


def extreme_order(df: DataFrame, key: str | Sequence[str], width_us: int, value: str, order: Sequence[str]) -> DataFrame:
    """Whether the peak or the trough of each coarse bar came first."""
    pos = F.struct(*[F.col(x) for x in order])
    first_max = F.max_by(pos, F.struct(F.col(value), (-F.unix_micros(order[0])).alias("e")))
    first_min = F.min_by(pos, F.struct(F.col(value), F.unix_micros(order[0]).alias("e")))
    g = df.groupBy(*as_list(key), floor_ts(order[0], width_us).alias("bar")).agg(
        first_max.alias("hi"), first_min.alias("lo"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("peak_first", F.when(F.col("hi") < F.col("lo"), 1).when(F.col("hi") > F.col("lo"), -1).otherwise(0)).drop("hi", "lo")


def velocity_shock(series: Series, w: int, n: int, threshold: float, after: int, price: str = "close") -> DataFrame:
    """k-bar move whose trailing robust z passes a threshold, and the move that followed."""

    def stage(d: DataFrame, fr: Frame) -> DataFrame:
        d = d.withColumn("velocity", W.diff(fr, F.col(price), w))
        d = d.withColumn("follow_up", F.lead(price, after).over(fr.w()) - F.col(price))
        d = robust_zscores(d, fr, {"vz": "velocity"}, n)
        return d.withColumn("shock", F.when(F.abs("vz") > threshold, F.signum("vz")).otherwise(F.when(F.col("vz").isNotNull(), 0)))

    return series.map(stage, back_rows=w + n + 1, fwd_rows=after)


def first_touch(series: Series, n: int, eps: float, max_touch: int, max_vol: float) -> DataFrame:
    """Bar reaching the prior n-bar high within eps, not touched by the bar before, closing back
    inside, with few earlier touches and low relative volume."""

    def stage(d: DataFrame, fr: Frame) -> DataFrame:
        ch = W.channel(fr, n)
        d = d.withColumn("level", ch["chan_high"])
        d = d.withColumn("earlier", touches(fr, F.col("level"), n, eps))
        mean_vol = F.avg("volume").over(fr.rows(-n, -1))
        d = d.withColumn("rel_volume", F.when(mean_vol > 0, F.col("volume") / mean_vol))
        hit = (F.col("high") >= F.col("level") - eps) & (F.lag("high").over(fr.w()) < F.col("level") - eps)
        ok = hit & (F.col("close") < F.col("level")) & (F.col("earlier") <= max_touch) & (F.col("rel_volume") <= max_vol)
        return d.withColumn("first_touch", F.coalesce(ok.cast("int"), F.lit(0)))

    return series.map(stage, back_rows=n + 1)


def episodes(series: Series, masks: dict[str, Column]) -> DataFrame:
    """Islands of each boolean mask: start, end and length."""
    key, order = list(series.key), list(series.order)
    flags = series.df.select(*key, *order, *[F.coalesce(m, F.lit(False)).alias(n) for n, m in masks.items()])
    long = flags.unpivot([*key, *order], list(masks), "mask", "on")
    s = Series(long, [*key, "mask"], order, series.bounded_rows, series.block_rows)
    runs = islands(s, "on").filter("on")
    return runs.groupBy(*key, "mask", "run").agg(
        F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("length")).drop("run")


def joint_rarity(series: Series, masks: dict[str, Column]) -> DataFrame:
    """Count and share of rows per combination of simultaneously true masks."""
    names = sorted(masks)
    combo = F.concat_ws("+", *[F.when(F.coalesce(masks[n], F.lit(False)), F.lit(n)) for n in names])
    cells = series.df.groupBy(combo.alias("combination")).agg(F.count(F.lit(1)).alias("n"))
    total = series.df.agg(F.count(F.lit(1)).alias("__t"))
    return cells.join(F.broadcast(total)).select("combination", "n", (F.col("n") / F.col("__t")).alias("share"))  # one row


def persistence_rows(series: Series, cond: Column, direction: Column, horizons: Sequence[int] = (1, 5), price: str = "close") -> DataFrame:
    """For each firing row: rows left in its run and the signed return after given horizons."""
    key = list(series.key)
    d = series.df.withColumn("__on", F.coalesce(cond, F.lit(False)))
    s = series.with_df(d)
    runs = s.with_df(islands(s, "__on")).numbered("__rn")
    ends = runs.groupBy(*key, "run").agg(F.max("__rn").alias("__end"))
    j = runs.join(ends, [*key, "run"]).withColumn("remaining", F.col("__end") - F.col("__rn"))
    out = series.with_df(j.drop("__end", "__brk", "run")).columns(
        lambda fr: {f"ret_{h}": direction * (F.lead(price, h).over(fr.w()) - F.col(price)) for h in horizons}, fwd_rows=max(horizons))
    return out.filter("__on").drop("__on", "__rn")


