"""Projections, filters and cleaning of quote tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.plans.quantiles import group_quantiles
from barline.plans.series import Series, as_list


def with_spread(df: DataFrame, dim: DataFrame, key: str, pip: str, bid: str = "bid", ask: str = "ask") -> DataFrame:
    """mid = (bid+ask)/2 and spread in pips.

    The dimension is a plain join side: Spark broadcasts it when its measured
    size allows and otherwise shuffles.
    """
    return (
        df.join(dim, key)
        .withColumn("mid", (F.col(bid) + F.col(ask)) / 2)
        .withColumn("spread", (F.col(ask) - F.col(bid)) / F.col(pip))
    )


def good_quote(spread: str, lo: float, hi: float) -> Column:
    return (F.col(spread) > lo) & (F.col(spread) < hi)


def clean_quotes(df: DataFrame, lo: float = 0.0, hi: float = 50.0, spread: str = "spread") -> DataFrame:
    return df.filter(good_quote(spread, lo, hi))


def quote_quality(df: DataFrame, by: str | Sequence[str], lo: float = 0.0, hi: float = 50.0, spread: str = "spread") -> DataFrame:
    """Kept and dropped row counts of the bad-quote filter."""
    ok = F.coalesce(good_quote(spread, lo, hi), F.lit(False))
    return df.groupBy(*as_list(by)).agg(
        F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped")
    )


def ffill(df: DataFrame, key: str | Sequence[str], order: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Last non-null value so far, ``{output: input}``."""
    return Series(df, key, order).running({out: ("last", F.col(src)) for out, src in cols.items()})


def hash_uniform(ids: Sequence[str | Column], seed: int) -> Column:
    """Uniform in [0, 1) that depends only on the row's id and the seed."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def coin(df: DataFrame, ids: Sequence[str], seed: int, name: str = "coin") -> DataFrame:
    """Fair +-1 per row, the same at any partitioning."""
    return df.withColumn(name, F.when(hash_uniform(ids, seed) < 0.5, F.lit(-1)).otherwise(F.lit(1)))


def sampled(id_col: str, seed: int, share: float) -> Column:
    return hash_uniform([id_col], seed + 1) < share


def random_k(df: DataFrame, by: str | Sequence[str], ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """``k`` random rows of each pool: the k smallest hashes, by running count."""
    rows = df.withColumn("__u", hash_uniform(ids, seed))
    return Series(rows, by, ["__u", *ids]).numbered("__rn").filter(F.col("__rn") <= k).drop("__rn", "__u")


def quantile_gate(df: DataFrame, key: str | Sequence[str], col: str, q: float, until: Column) -> DataFrame:
    """Keep rows at or below a quantile measured on the in-sample part only."""
    edges = group_quantiles(df.filter(until), key, col, {"__gate": q})
    return df.join(edges, as_list(key)).filter(F.col(col) <= F.col("__gate")).drop("__gate")
