"""Exact group quantiles and average ranks without gathering a group.

``percentile`` keeps all distinct values of a group in one aggregation buffer.
Here values are counted per (group, value) with map-side combine, numbered with
a running count that splits hot groups, and the needed order statistics are
picked with a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.plans.series import Series, as_list


def group_quantiles(
    df: DataFrame,
    by: str | Sequence[str] | None,
    col: str,
    qs: dict[str, float],
    count_name: str | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{name: q}``."""
    keys = as_list(by)
    vc = (
        df.filter(F.col(col).isNotNull())
        .groupBy(*keys, F.col(col).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cum = Series(vc, keys, ["__v"]).running({"__c": ("sum", F.col("__n"))})
    totals = vc.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    if keys:
        joined = cum.join(totals, keys)
    else:
        joined = cum.join(F.broadcast(totals))  # a single row
    aggs = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("__t") - 1)
        low = F.floor(pos)
        high = F.ceil(pos)
        aggs += [
            F.min(F.when(F.col("__c") > low, F.col("__v"))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__c") > high, F.col("__v"))).alias(f"__hi_{name}"),
        ]
    out = joined.groupBy(*keys).agg(F.max("__t").alias("__t"), *aggs)
    cols = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("__t") - 1)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    extra = [F.col("__t").alias(count_name)] if count_name else []
    return out.select(*keys, *cols, *extra)


def average_ranks(df: DataFrame, by: str | Sequence[str] | None, col: str, name: str) -> DataFrame:
    """Average-tie rank of ``col`` inside each group, added as ``name``."""
    keys = as_list(by)
    vc = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    cum = Series(vc, keys, [col]).running({"__c": ("sum", F.col("__n"))})
    ranks = cum.select(*keys, col, (F.col("__c") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, col], "left")


def ntile_labels(df: DataFrame, by: str | Sequence[str] | None, order: Sequence[str], n: int, name: str) -> DataFrame:
    """``ntile(n)`` per group with the running row number instead of one sorted task."""
    keys = as_list(by)
    s = Series(df, keys, list(order))
    numbered = s.numbered("__rn")
    totals = s.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__t"))
    joined = numbered.join(totals, keys) if keys else numbered.join(F.broadcast(totals))
    base, extra = F.floor(F.col("__t") / n), F.col("__t") % n
    big = (base + 1) * extra
    label = F.when(F.col("__rn") <= big, F.floor((F.col("__rn") - 1) / (base + 1))).otherwise(
        extra + F.floor((F.col("__rn") - 1 - big) / base)
    )
    return joined.withColumn(name, (label + 1).cast("long")).drop("__rn", "__t")

