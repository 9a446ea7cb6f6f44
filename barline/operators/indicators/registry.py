"""Registration surface: ``fn(d, fr, **params) -> d`` plus the halo rows it needs."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.plans.series import Series


@dataclass(frozen=True)
class Indicator:
    fn: Callable[..., DataFrame]
    back: Callable[..., int]
    params: dict


INDICATORS: dict[str, Indicator] = {}


def indicator(back: int | Callable[..., int]):
    """Register under the function's name; ``back`` gives the rows of history it needs."""

    def deco(fn):
        params = {
            k: p.default for k, p in inspect.signature(fn).parameters.items() if p.default is not inspect.Parameter.empty
        }
        rows = back if callable(back) else (lambda **_: back)
        INDICATORS[fn.__name__] = Indicator(fn, rows, params)
        return fn

    return deco


def with_indicators(series: Series, names: Iterable[str | tuple[str, dict]]) -> DataFrame:
    """Add the columns of several indicators.

    A bare name uses default parameters; ``(name, params)`` appends the
    parameter values to the output names, so one indicator can be asked for
    several times.
    """
    plan = []
    for item in names:
        name, params = (item, {}) if isinstance(item, str) else item
        ind = INDICATORS[name]
        unknown = set(params) - set(ind.params)
        if unknown:
            raise ValueError(f"{name}: unknown parameters {sorted(unknown)}")
        plan.append((ind, {**ind.params, **params}, "_".join(str(v).replace(".", "p") for v in params.values())))

    def stage(d: DataFrame, fr):
        for ind, params, suffix in plan:
            before = set(d.columns)
            d = ind.fn(d, fr, **params)
            if suffix:
                for c in [c for c in d.columns if c not in before and not c.startswith("__")]:
                    d = d.withColumnRenamed(c, f"{c}_{suffix}")
        return d

    need = max((ind.back(**params) for ind, params, _ in plan), default=0)
    return series.map(stage, back_rows=need + 2)


VOTE_AVERAGES = (10, 20, 30, 50, 100, 200)
OSCILLATORS = ("rsi", "stochastic", "cci", "adx", "awesome", "momentum", "macd", "stoch_rsi", "williams_r", "bull_bear", "ultimate")


def votes(series: Series) -> DataFrame:
    """The 26 votes of the rating as columns ``vote_*``: +1, 0 or -1, null in warm-up.

    Fifteen compare price with averages (six simple, six exponential, the base line, the
    volume-weighted one) or take the direction of the Hull average; eleven oscillators vote
    on level, most of them only when they turn as well.
    """
    lengths = [(n, {"n": k}) for n in ("sma", "ema") for k in VOTE_AVERAGES]
    d = with_indicators(series, [
        *lengths, "base_line", "vwma", "hull", "rsi", "stochastic", "cci", "adx", "awesome", "momentum", "macd", "stoch_rsi",
        "williams_r", ("ema", {"n": 13}), "ultimate"])
    d = d.withColumn("bull_bear", F.col("high") + F.col("low") - 2 * F.col("ema_13"))

    def stage(d: DataFrame, fr) -> DataFrame:
        smooth = {"__k": "stoch_d", "__r": "stoch_rsi"}  # signal lines: means of three
        full = lambda x: F.when(F.count(x).over(fr.last_n(3)) == 3, F.avg(x).over(fr.last_n(3)))
        d = d.withColumns({n: full(x) for n, x in smooth.items()})
        back = lambda x: F.lag(x).over(fr.w())

        def vote(up: Column, down: Column, *needs: str) -> Column:
            ready = [F.col(x).isNotNull() & back(x).isNotNull() for x in needs]
            return F.when(reduce(Column.__and__, ready), F.when(up, 1.0).when(down, -1.0).otherwise(0.0))

        def turns(x: str, low: float, high: float) -> Column:
            """Buys below the low level on the way up, sells above the high one on the way down."""
            return vote((F.col(x) < low) & (F.col(x) > back(x)), (F.col(x) > high) & (F.col(x) < back(x)), x)

        def swings(x: str) -> Column:
            return vote((F.col(x) > 0) & (F.col(x) > back(x)), (F.col(x) < 0) & (F.col(x) < back(x)), x)

        k, sk, r, sr, adx = (F.col(x) for x in ("stoch_d", "__k", "stoch_rsi", "__r", "adx"))
        plus, minus = F.col("plus_di"), F.col("minus_di")
        above = {f"{n}_{p['n']}": F.signum(F.col("close") - F.col(f"{n}_{p['n']}")) for n, p in lengths}
        above |= {x: F.signum(F.col("close") - F.col(x)) for x in ("base_line", "vwma")}
        found = {
            **above,
            "hull": F.signum(F.col("hull") - back("hull")),
            "rsi": turns("rsi", 30, 70),
            "stochastic": vote((k < 20) & (sk < 20) & (k > sk), (k > 80) & (sk > 80) & (k < sk), "stoch_d", "__k"),
            "cci": turns("cci", -100, 100),
            "adx": vote((adx > 20) & (plus > minus), (adx > 20) & (minus > plus), "adx"),
            "awesome": swings("awesome"),
            "momentum": vote(F.col("momentum") > back("momentum"), F.col("momentum") < back("momentum"), "momentum"),
            "macd": F.signum(F.col("macd") - F.col("macd_signal")),
            "stoch_rsi": vote((r < 20) & (r > sr), (r > 80) & (r < sr), "stoch_rsi", "__r"),
            "williams_r": turns("williams_r", -80, -20),
            "bull_bear": swings("bull_bear"),
            "ultimate": vote(F.col("ultimate") > 70, F.col("ultimate") < 30, "ultimate"),
        }
        return d.select("*", *[v.alias(f"vote_{n}") for n, v in found.items()]).drop(*smooth)

    return series.with_df(d).map(stage, back_rows=6)


def vote_rating(series: Series) -> DataFrame:
    """``ma_rating``, ``osc_rating`` and ``rating``: means of the votes that are not null."""
    d = votes(series)
    every = [c for c in d.columns if c.startswith("vote_")]
    osc = [f"vote_{o}" for o in OSCILLATORS]

    def mean(names: list[str]) -> Column:
        n = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
        return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in names), F.lit(0.0)) / n)

    n_votes = sum((F.col(c).isNotNull().cast("int") for c in every), F.lit(0))
    return d.select(
        *series.key, *series.order, mean([c for c in every if c not in osc]).alias("ma_rating"), mean(osc).alias("osc_rating"),
        mean(every).alias("rating"), n_votes.alias("n_votes"))
