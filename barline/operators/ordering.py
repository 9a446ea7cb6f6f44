"""Sorts, limits, top-k, circular windows and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.plans.series import Series, as_list


def sort_bars(df: DataFrame, key: str | Sequence[str], order: Sequence[str], within: bool = False) -> DataFrame:
    """Global sort (range partitioned), or a sort inside hash partitions of the key."""
    cols = [*as_list(key), *order]
    return df.repartition(*as_list(key)).sortWithinPartitions(*cols) if within else df.orderBy(*cols)


def global_position(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Position in the global order, computed block-wise when the table is large."""
    return Series(df, None, list(order)).numbered(out)


def latest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_bottom(df: DataFrame, ts: str | Sequence[str], score: str, k: int, tie: str) -> DataFrame:
    """k best (+1) and k worst (-1) per time, k = min(k, n // 2).

    Ranks are counted from both ends by running counts, so a crowded instant is
    cut into blocks of the score.
    """
    keys = as_list(ts)
    rows = df.filter(F.col(score).isNotNull()).withColumn("__neg", -F.col(score))
    down = Series(rows, keys, [score, tie]).numbered("__dn")
    up = Series(down, keys, ["__neg", tie]).numbered("__up")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    j = up.join(n, keys) if keys else up.join(F.broadcast(n))
    kk = F.least(F.lit(k), F.floor(F.col("__n") / 2))
    return (
        j.withColumn("leg", F.when(F.col("__up") <= kk, F.lit(1)).when(F.col("__dn") <= kk, F.lit(-1)))
        .filter(F.col("leg").isNotNull())
        .drop("__neg", "__dn", "__up", "__n")
    )


def best_by(df: DataFrame, by: str | Sequence[str], score: Sequence[str]) -> DataFrame:
    """Best row per group as a max of a struct (partial aggregation, no sort)."""
    keys = as_list(by)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*score)).alias("__r")).select(*keys, "__r.*")


def circular_extreme(df: DataFrame, key: str | Sequence[str], slot: str, value: str, width: int, slots: int, largest: bool = False) -> DataFrame:
    """Start slot of the cheapest (or dearest) window of ``width`` slots on a circle.

    Each slot adds its value to the ``width`` window starts that cover it.
    """
    keys = as_list(key)
    starts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pmod(F.col(slot) - i, F.lit(slots)))
    win = (
        df.select(*keys, F.explode(starts).alias("__start"), F.col(value).alias("__v"))
        .groupBy(*keys, "__start")
        .agg(F.avg("__v").alias("__m"), F.count("__v").alias("__n"))
        .filter(F.col("__n") == width)
    )
    m = -F.col("__m") if largest else F.col("__m")
    pick = F.min(F.struct(m.alias("m"), F.col("__start").alias("s"))).alias("__p")
    val = -F.col("__p.m") if largest else F.col("__p.m")
    return win.groupBy(*keys).agg(pick).select(*keys, F.col("__p.s").alias("best_slot"), val.alias("best_value"))


def concat(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_rows(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).subtract(b.select(*on))
