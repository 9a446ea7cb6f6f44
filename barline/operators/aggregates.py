"""Grouped summaries, buckets, pivots, moments, entropy, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.plans.quantiles import group_quantiles
from barline.plans.series import as_list


def ledger_summary(df: DataFrame, by: str | Sequence[str], pnl: str = "pnl") -> DataFrame:
    return df.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("total"), F.count_if(F.col(pnl) > 0).alias("wins"),
        F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"),
    )


def perf_stats(df: DataFrame, by: str | Sequence[str], pnl: str = "pnl", ts: str = "exit_time") -> DataFrame:
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))
    return df.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.when(loss > 0, gain / loss).alias("profit_factor"),
        F.avg(F.when(p > 0, p)).alias("avg_win"),
        F.avg(F.when(p < 0, p)).alias("avg_loss"),
        (F.count(F.lit(1)) / F.count_distinct(F.to_date(ts))).alias("per_day"),
    )


def bucket_quantiles(df, by, col: str, qs: dict[str, float], count_name: str | None = None) -> DataFrame:
    return group_quantiles(df, by, col, qs, count_name)


def last_by(df: DataFrame, by, col: str, order: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.max_by(col, F.struct(*order)).alias(out))


def avg_if(cond: Column, x: Column) -> Column:
    return F.avg(F.when(cond, x))


def histogram(df: DataFrame, col: str, bins: int, cap: float = 0.99) -> DataFrame:
    """Fixed-width bins from 0 to the ``cap`` quantile; larger values fall in the last bin."""
    edge = group_quantiles(df, None, col, {"__cap": cap})
    binned = df.filter(F.col(col).isNotNull()).join(F.broadcast(edge))  # one row
    idx = F.least(F.floor(F.col(col) / F.col("__cap") * bins), F.lit(bins - 1))
    return binned.groupBy(idx.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("__cap") / bins * F.max(idx)).alias("lower")
    )


def quantile_bucket(df: DataFrame, key, col: str, n: int, out: str) -> DataFrame:
    """Per-group quantile label 0..n-1 from exact edges (right-closed)."""
    qs = {f"__q{i}": i / n for i in range(1, n)}
    edges = group_quantiles(df, key, col, qs)
    keys = as_list(key)
    # a group without any value keeps its rows with a null label
    j = df.join(edges, keys, "left") if keys else df.join(F.broadcast(edges))
    label = sum(((F.col(col) > F.col(q)).cast("int") for q in qs), F.lit(0))
    return j.withColumn(out, F.when(F.col(col).isNotNull(), label)).drop(*qs)


def cut(col: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: labels[0] for x <= bounds[0] and so on."""
    out = None
    for b, lab in zip(bounds, labels):
        out = F.when(col <= b, F.lit(lab)) if out is None else out.when(col <= b, F.lit(lab))
    return F.when(col.isNotNull(), out.otherwise(F.lit(labels[len(bounds)])))


def grid_mean(df: DataFrame, b1: str, b2: str, y: str, key: str) -> DataFrame:
    """Bucket x bucket: mean outcome, count, and number of series whose own mean is positive."""
    per_key = df.groupBy(b1, b2, key).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    return per_key.groupBy(b1, b2).agg(
        (F.sum("__s") / F.sum("__n")).alias("mean"), F.sum("__n").alias("n"),
        F.count_if(F.col("__s") > 0).alias("n_positive"),
    )


def crosstab_pct(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of each b within a, in percent."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("__t"))
    return cells.join(rows, a).select(a, b, "n", (F.col("n") * 100.0 / F.col("__t")).alias("pct"))


def rollup_stats(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Subtotals per prefix of ``by`` and overall; ``level`` is the grouping id."""
    return df.rollup(*by).agg(F.grouping_id().alias("level"), *aggs)


def describe_by(df: DataFrame, by, col: str) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std_pop"),
        F.stddev_samp(col).alias("std"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurt"),
        F.min(col).alias("lo"), F.max(col).alias("hi"),
    )


def daily_matrix(ledger: DataFrame, group: str, ts: str, pnl: str) -> DataFrame:
    """Daily sum per group; 0 on idle days inside its life, no row outside."""
    daily = ledger.groupBy(group, F.to_date(ts).alias("day")).agg(F.sum(pnl).alias("v"))
    life = daily.groupBy(group).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = life.select(group, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily, [group, "day"], "left").select(group, "day", F.coalesce("v", F.lit(0.0)).alias("v"))


def weighted_mean(df: DataFrame, by, weights: dict[str, float], label: str, value: str, out: str) -> DataFrame:
    """Mean of long rows weighted by a label -> weight map; null values drop their weight."""
    from barline.functions.scalar import weight_map

    w = weight_map(weights)[F.col(label)]
    w = F.when(F.col(value).isNotNull(), w)
    total = F.sum(w)
    return df.groupBy(*as_list(by)).agg(F.when(total != 0, F.sum(w * F.col(value)) / total).alias(out))


def sign_agreement(df: DataFrame, by, a: str, b: str, out: str) -> DataFrame:
    same = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.signum(a) == F.signum(b)).cast("double"))
    return df.groupBy(*as_list(by)).agg(F.avg(same).alias(out))


def entropy(df: DataFrame, by, cols: Sequence[str], out: str) -> DataFrame:
    """Shannon entropy in bits of the joint distribution of ``cols``."""
    keys = as_list(by)
    cells = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("__n"))
    # H = log2 N - sum(n log2 n) / N needs one more aggregate only
    return cells.groupBy(*keys).agg(
        (F.log2(F.sum("__n").cast("double")) - F.sum(F.col("__n") * F.log2(F.col("__n").cast("double"))) / F.sum("__n")).alias(out)
    )


def cov_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long covariance and correlation matrix, all pairs in one aggregate row."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.struct(F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}.cov"), F.col(f"p{i}.corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")
