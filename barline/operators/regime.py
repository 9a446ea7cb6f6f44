"""Regime feature vector of consecutive windows, composed from window expressions.

A window is a bounded number of consecutive rows, so extremes, legs and slopes
are ordinary frames and aggregates per (key, window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import windows as W
from barline.plans.series import Series


def _alternate(points: Series) -> DataFrame:
    """Most extreme point of each run of one type inside a window (first on ties)."""
    from barline.operators.events import islands

    key = list(points.key)
    runs = islands(points, "is_high")
    signed = F.when(F.col("is_high") == 1, -F.col("x")).otherwise(F.col("x"))
    return runs.groupBy(*key, "run").agg(
        F.min(F.struct(signed.alias("s"), F.col("i"), F.col("x"), F.col("is_high"))).alias("b")
    ).select(*key, "b.i", "b.x", "b.is_high")


def regime_vector(series: Series, col: str, window: int) -> DataFrame:
    """Drift, efficiency, volatility, envelope slopes, leg growth and variance ratios per window."""
    key, ts = list(series.key), series.order[0]
    d = series.numbered("__rn").select(*key, ts, F.col(col).cast("double").alias("x"), F.floor((F.col("__rn") - 1) / window).alias("win"), F.pmod(F.col("__rn") - 1, F.lit(window)).alias("i"))
    g = [*key, "win"]
    s = Series(d, g, ["i"], bounded_rows=window)

    def stage(x, fr):
        w = fr.w()
        x = x.withColumn("d1", W.diff(fr, F.col("x")))
        for k in (2, 4, 8):
            x = x.withColumn(f"d{k}", W.diff(fr, F.col("x"), k))
        before, after = F.lag("x").over(w), F.lead("x").over(w)
        return x.withColumn("is_high", F.when((F.col("x") > before) & (F.col("x") > after), 1).when((F.col("x") < before) & (F.col("x") < after), 0))

    d = s.map(stage)
    base = d.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("x", "i").alias("x0"), F.max_by("x", "i").alias("x1"), F.max(ts).alias(ts), F.max("i").alias("i1"),
        F.stddev_pop("d1").alias("rv"),
        *[F.when(F.var_pop("d1") > 0, F.var_pop(f"d{k}") / (k * F.var_pop("d1"))).alias(f"vr{k}") for k in (2, 4, 8)],
    ).filter(F.col("n") == window)
    alt = _alternate(Series(d.filter(F.col("is_high").isNotNull()), g, ["i"], bounded_rows=window))
    slopes = alt.groupBy(*g).agg(
        *[F.when(F.count_if(F.col("is_high") == h) >= 2, F.regr_slope(F.when(F.col("is_high") == h, F.col("x")), F.col("i"))).alias(n)
          for h, n in ((1, "peak_slope"), (0, "trough_slope"))])
    # legs run from the first value over the turning points to the last value
    ends = base.select(*g, F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.col("x0").alias("x")), F.struct(F.lit(window).cast("long").alias("i"), F.col("x1").alias("x")))).alias("e")).select(*g, "e.i", "e.x")
    pts = Series(ends.unionByName(alt.select(*g, F.col("i").cast("long").alias("i"), "x")), g, ["i"], bounded_rows=window + 2)
    legs = pts.columns(lambda fr: {"leg": F.abs(W.diff(fr, F.col("x"))), "q": F.row_number().over(fr.w())}).filter(F.col("leg").isNotNull())
    leg = legs.groupBy(*g).agg(F.count(F.lit(1)).alias("n_legs"), F.sum("leg").alias("path"), F.regr_slope(F.col("leg"), F.col("q")).alias("ls"))
    out = base.join(leg, g, "left").join(slopes, g, "left")
    drift = F.col("x1") - F.col("x0")
    return out.select(*key, ts, drift.alias("drift"), F.when(F.col("path") > 0, F.abs(drift) / F.col("path")).alias("er"), "rv", "peak_slope", "trough_slope",
                      F.when(F.col("n_legs") >= 4, F.col("ls")).alias("leg_expansion"), "n_legs", "vr2", "vr4", "vr8")
