"""The wide causal feature set: all columns from one layout of the series.

Cumulative inputs (swing index, signed volume, global bar number) are running
sums with block carry; everything else is one stage of frames and scans.
Values are null until their window is full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import clock_features
from barline.functions.shape import true_range
from barline.operators import kernels as K
from barline.operators import windows as W
from barline.operators.indicators.frames import c, h, hh, l, ll, o, ready, v
from barline.operators.indicators.levels import LIMIT_ATR, add_limited_index
from barline.operators.indicators.scans import wrows
from barline.operators.kernel_ops import asi_consensus
from barline.plans.orderstats import OrderStat, order_statistics
from barline.plans.scan import ema_rows, emas
from barline.plans.sequential import run_kernel
from barline.plans.series import Frame, Series
from barline.sources.sinks import materialize

HALF_PI = math.pi / 2
PROFILE_BINS = 20


def squashed(x: Column, scale: float) -> Column:
    return F.atan(x / scale) / HALF_PI


def signed_efficiency(fr: Frame, n: int) -> Column:
    """Net move over path length of the last n bars, with the sign of the move; needs ``__dc``."""
    path = F.sum("__dc").over(fr.last_n(n))
    old = F.lag("close", n).over(fr.w())
    return F.when(old.isNotNull(), F.when(path > 1e-12, (c() - old) / path).otherwise(0.0))


def candle_features(fr: Frame) -> dict[str, Column]:
    po, ph, pl, pc = (F.lag(x).over(fr.w()) for x in ("open", "high", "low", "close"))
    p2 = F.lag("close", 2).over(fr.w())
    rng, prng, body, pbody = h() - l(), ph - pl, c() - o(), pc - po
    up = (body > 0) & (pbody < 0) & (c() >= po) & (o() <= pc)
    dn = (body < 0) & (pbody > 0) & (c() <= po) & (o() >= pc)
    mean = F.avg(rng).over(fr.last_n(20))
    return {
        "body_pips": F.when(c() > 0, body / c() * 1e4),
        "body_ratio": F.when(rng > 1e-12, F.abs(body) / rng).otherwise(0.0),
        "candle_range": F.when(c() > 0, rng / c()),
        "gap_norm": F.when(pc.isNotNull(), F.when(prng > 1e-12, (o() - pc) / prng).otherwise(0.0)),
        "two_bar_momentum": F.when(p2.isNotNull(), F.when(prng > 1e-12, (c() - p2) / prng).otherwise(0.0)),
        "dlog_close_pos": F.when((pc > 0) & (c() > 0), F.log(c() / pc)),
        "range_expansion": ready(fr, 20, F.when(mean > 1e-12, rng / mean).otherwise(1.0)),
        "is_engulfing": F.when(pc.isNotNull(), F.when(up, 1).when(dn, -1).otherwise(0)),
        "is_inside_bar": F.when(pc.isNotNull(), ((h() <= ph) & (l() >= pl)).cast("int")),
    }


def frame_features(fr: Frame) -> dict[str, Column]:
    w30, w20, w200 = fr.last_n(30), fr.last_n(20), fr.rows(-200, -1)
    sd, mean = F.stddev_pop("close").over(w20), F.avg("close").over(w20)
    path60 = F.sum("__dc").over(fr.last_n(60))
    er = F.try_divide(F.abs(c() - F.lag("close", 60).over(fr.w())), path60)

    def pos(n: int) -> Column:
        return ready(fr, n, F.when(hh(fr, n) - ll(fr, n) > 1e-12, (c() - ll(fr, n)) / (hh(fr, n) - ll(fr, n))).otherwise(0.5))

    chan_ok = F.count("high").over(w200) == 200
    pdelta, cdelta = c() - F.first("close").over(w30), F.col("__cvd") - F.first("__cvd").over(w30)
    asi_hi, asi_lo = F.max("asi").over(fr.rows(-200, -1)), F.min("asi").over(fr.rows(-200, -1))
    return {
        "er_norm": F.when(F.lag("close", 60).over(fr.w()).isNotNull(), F.when(path60 > 0, squashed(er, 0.3)).otherwise(0.0)),
        "roc_10": W.pct_change(fr, c(), 10),
        "range_pos_30": pos(30),
        "bb_width": ready(fr, 20, F.when(c() > 0, 4.0 * sd / c())),
        "bb_pos": ready(fr, 20, F.when(sd > 1e-12, (c() - mean) / (2.0 * sd)).otherwise(0.0)),
        "aroon_osc": (W.bars_since(fr, "low", 25, "__rn", "min", oldest=True) - W.bars_since(fr, "high", 25, "__rn", oldest=True)) / 25.0,
        "stoch_k": pos(14),
        "donchian_pos": pos(20),
        "williams_r": pos(14) - 1.0,
        "cvd_delta": squashed(F.col("__sv"), 1000.0),
        "cvd_cum": squashed(F.col("__cvd"), 1e6),
        "cvd_divergence_30": ready(fr, 30, (F.signum(pdelta) - F.signum(cdelta)) / 2.0),
        "vol_ratio_20": ready(fr, 20, squashed(F.col("__vr"), 2.0)),
        "hh_price": F.when(chan_ok, (c() >= F.max("high").over(w200)).cast("int")),
        "hl_price": F.when(chan_ok, (c() <= F.min("low").over(w200)).cast("int")),
        "hh_asi": F.when(chan_ok, (F.col("asi") >= asi_hi).cast("int")),
        "hl_asi": F.when(chan_ok, (F.col("asi") <= asi_lo).cast("int")),
        "tsf_slope": W.slope(fr, c(), F.col("__rn"), 14),
        "tec5": signed_efficiency(fr, 5),
        "dtec": signed_efficiency(fr, 3) - signed_efficiency(fr, 13),
    }


def volume_profile(fr: Frame, n: int = 100) -> dict[str, Column]:
    """Distance to the busiest price bin and high/low volume node flag of the last n bars."""
    w = fr.last_n(n)
    lo, hi = F.min("close").over(w), F.max("close").over(w)
    return {"__vp": F.collect_list(F.struct("close", "volume")).over(w), "__vlo": lo, "__vw": (hi - lo) / PROFILE_BINS}


def profile_columns() -> dict[str, Column]:
    lo, width = F.col("__vlo"), F.col("__vw")

    def bin_of(x: Column) -> Column:
        return F.least(F.floor(F.try_divide(x - lo, width)).cast("int"), F.lit(PROFILE_BINS - 1))

    def volume_in(i: Column) -> Column:
        return F.aggregate("__vp", F.lit(0.0), lambda acc, s: acc + F.when(bin_of(s["close"]) == i, s["volume"]).otherwise(0.0))

    hist = F.transform(F.sequence(F.lit(0), F.lit(PROFILE_BINS - 1)), volume_in)
    return {"__hist": F.when(width > 1e-12, hist), "__cur": bin_of(c())}


def profile_values() -> dict[str, Column]:
    top = F.array_position("__hist", F.array_max("__hist")) - 1
    srt = F.array_sort("__hist")
    cur = F.get("__hist", F.col("__cur"))
    node = F.when(cur >= srt[int(0.8 * PROFILE_BINS)], 1).when(cur <= srt[int(0.2 * PROFILE_BINS)], -1).otherwise(0)
    poc = F.col("__vlo") + (top + 0.5) * F.col("__vw")
    ok = F.size("__vp") >= 50
    return {
        "dist_to_poc_100": F.when(ok & F.col("__hist").isNotNull(), (c() - poc) / (F.col("__vw") * PROFILE_BINS)),
        "at_hvn_lvn": F.when(ok & F.col("__hist").isNotNull(), node),
    }


def causal_features(series: Series, median_rows: int = 2016, consensus_steps: tuple[int, ...] = (1, 2, 6, 12)) -> DataFrame:
    """All features; ``median_rows`` is the length of the regime medians (a week of 5-minute bars)."""
    key, order = list(series.key), list(series.order)
    # written once where the plan branches: each part would be planned and run again per branch
    base = materialize(asi_consensus(series, steps=consensus_steps), "consensus")
    s = series.with_df(base)

    def signed(d, fr):
        move = c() - F.lag("close").over(fr.w())
        side = F.when(move.isNull() | (move > 0), 1.0).when(move < 0, -1.0).otherwise(0.0)
        return add_limited_index(d.withColumn("__sv", side * v()), fr, "__si")

    s = s.with_df(s.map(signed, back_rows=wrows(LIMIT_ATR) + 2))
    s = s.with_df(s.running({"__cvd": ("sum", F.col("__sv")), "asi": ("sum", F.col("__si")), "__rn": ("count", F.lit(1))}))

    def stage(d: DataFrame, fr: Frame) -> DataFrame:
        keep = d.columns
        mean_vol = F.avg("volume").over(fr.last_n(20))
        d = d.select("*", F.abs(W.diff(fr, c())).alias("__dc"), true_range(fr).alias("__tr"), F.when(mean_vol > 0, v() / mean_vol).otherwise(1.0).alias("__vr"))
        d = d.select("*", *[x.alias(n) for n, x in {**candle_features(fr), **frame_features(fr), **volume_profile(fr)}.items()])
        d = d.select("*", *[x.alias(n) for n, x in profile_columns().items()])
        d = d.select("*", *[x.alias(n) for n, x in profile_values().items()]).drop("__vp", "__hist", "__cur", "__vlo", "__vw")
        move = c() - F.lag("close").over(fr.w())
        ph, pl = F.lag("high").over(fr.w()), F.lag("low").over(fr.w())
        d = d.withColumns({"__mv": move, "__rise": h() - ph, "__fall": pl - l(), "__tp": (h() + l() + c()) / 3.0})
        up, dn, known = F.col("__rise"), F.col("__fall"), F.col("__rise").isNotNull()
        first_scans = {f"__e{n}": (c(), 2.0 / (n + 1), None) for n in (8, 21, 12, 26, 20, 24)}
        first_scans |= {"__atr": (F.col("__tr"), 1.0 / 14, 14), "__atr10": (F.col("__tr"), 0.1, 10)}
        first_scans |= {
            "__ag": (F.when(F.col("__mv").isNotNull(), F.greatest("__mv", F.lit(0.0))), 1.0 / 14, 14),
            "__al": (F.when(F.col("__mv").isNotNull(), F.greatest(-F.col("__mv"), F.lit(0.0))), 1.0 / 14, 14),
            "__at": (F.when(known, F.col("__tr")), 1.0 / 14, 14),
            "__ap": (F.when(known, F.when((up > dn) & (up > 0), up).otherwise(0.0)), 1.0 / 14, 14),
            "__an": (F.when(known, F.when((dn > up) & (dn > 0), dn).otherwise(0.0)), 1.0 / 14, 14),
        }
        d = emas(d, fr, first_scans)
        pdi, ndi = F.try_divide(F.col("__ap"), F.col("__at")), F.try_divide(F.col("__an"), F.col("__at"))
        d = d.withColumns({
            "ema8_ratio": F.try_divide(c(), F.col("__e8")),
            "ema21_ratio": F.try_divide(c(), F.col("__e21")),
            "atr_ratio": F.when(c() > 0, F.col("__atr") / c()),
            "rsi_14": F.when(F.col("__al").isNotNull(), F.when(F.col("__al") <= 0, 1.0).otherwise(1.0 - 1.0 / (1.0 + F.col("__ag") / F.col("__al")))),
            "__m": F.col("__e12") - F.col("__e26"),
            "dmi_diff": pdi - ndi,
            "__dx": F.when(F.col("__at").isNotNull(), F.abs(pdi - ndi) / F.greatest(pdi + ndi, F.lit(1e-12))),
        })
        d = emas(d, fr, {"__sg": (F.col("__m"), 0.2, None), "adx": (F.col("__dx"), 1.0 / 14, None)})
        mad = W.mean_abs_dev(fr, F.col("__tp"), 20)
        sd, mean = F.stddev_pop("close").over(fr.last_n(20)), F.avg("close").over(fr.last_n(20))
        inside = (mean + 2 * sd <= F.col("__e20") + 1.5 * F.col("__atr10")) & (mean - 2 * sd >= F.col("__e20") - 1.5 * F.col("__atr10"))
        d = d.withColumns({
            "macd_hist": F.when(F.col("__atr") > 0, (F.col("__m") - F.col("__sg")) / F.col("__atr")),
            "stoch_d": W.roll(fr, F.col("stoch_k"), 3, "mean"),
            "cci": F.when(mad > 0, (F.col("__tp") - F.avg("__tp").over(fr.last_n(20))) / (0.015 * mad) / 200.0),
            "squeeze": ready(fr, 20, inside.cast("int")),
            "vol_capitulation": F.when(F.col("__atr").isNotNull(), ((F.col("__vr") > 2.5) & (F.abs(W.diff(fr, c())) > 2.0 * F.col("__atr"))).cast("int")),
        })
        d = d.withColumn("__slope", F.abs(F.col("__e24") - F.lag("__e24", 12).over(fr.w())) / 12.0)
        w = fr.last_n(median_rows)
        d = d.withColumn("__enough", F.count("__slope").over(w) >= 50)
        # every 12th bar completes a coarse bar: its close against the one three coarse bars before
        coarse = F.when((F.col("__rn") % 12 == 0) & (F.col("__rn") >= 48), (c() - F.lag("close", 36).over(fr.w())) / 3.0 * F.try_divide(F.lit(1e4), c()))
        d = d.withColumn("__h1", squashed(coarse, 20.0))
        d = d.withColumn("h1_slope", F.last("__h1", ignorenulls=True).over(fr.last_n(12)))
        d = d.drop(*[x for x in d.columns if x.startswith("__") and x not in keep and x not in ("__blk", "__own", "__atr10", "__atr", "__slope", "__enough")])
        d = order_statistics(d, fr, {f"{x}_mid": OrderStat("quantile", x, median_rows, partial=True) for x in ("__slope", "__atr")})
        enough, smed, amed = F.col("__enough"), F.col("__slope_mid"), F.col("__atr_mid")
        d = d.select("*", F.when(enough, (F.col("__slope") > smed).cast("int")).alias("trending"), F.when(enough, (F.col("__atr") > amed).cast("int")).alias("high_vol"),
                     F.when(enough & (amed > 1e-12), F.col("__atr") / amed).alias("vol_regime"))
        return d.drop(*[x for x in d.columns if x.startswith("__") and x not in keep and x not in ("__blk", "__own", "__atr10")])

    need = median_rows + ema_rows(26) + wrows(14) * 2 + 250
    d = s.map(stage, back_rows=need)
    clock = clock_features(order[0])
    d = d.select("*", *[clock[n].alias(n) for n in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")])
    d = materialize(d, "features")
    s2 = series.with_df(d)
    sar = run_kernel(s2, K.parabolic_sar(guarded=False)).select(*key, *order, F.col("sar_dir").alias("psar_signal"))
    st_in = s2.with_df(d.withColumn("st_atr", F.col("__atr10")))
    st = run_kernel(st_in, K.super_trend()).select(*key, *order, F.col("st_dir").alias("supertrend"))
    out = d.join(sar, [*key, *order]).join(st, [*key, *order])
    return out.withColumn("supertrend", F.when(F.col("__atr10").isNotNull(), F.col("supertrend"))).drop("__sv", "__si", "__cvd", "__rn", "__atr10", "asi_smooth")
