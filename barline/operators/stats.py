"""Information coefficients, robust t, resampling by hashes, folds, gates.

All random draws are hashes of (seed, replicate, row id): results do not depend
on partitioning and lost tasks recompute the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.cleaning import hash_uniform
from barline.plans.bijection import permuted
from barline.plans.quantiles import average_ranks, group_quantiles, ntile_labels
from barline.plans.series import DEFAULT_BROADCAST_ROWS, Series, as_list
from barline.sources.sinks import materialize


def ic(df: DataFrame, signal: str, y: str, method: str = "pearson", by: str | Sequence[str] | None = None) -> DataFrame:
    """Correlation of signal and outcome with its t-statistic; Spearman uses average-tie ranks."""
    keys = as_list(by)
    d = df.filter(F.col(signal).isNotNull() & F.col(y).isNotNull())
    a, b = signal, y
    if method == "spearman":
        d = average_ranks(average_ranks(d, keys, signal, "__ra"), keys, y, "__rb")
        a, b = "__ra", "__rb"
    g = d.groupBy(*keys).agg(F.corr(a, b).alias("ic"), F.count(F.lit(1)).alias("n"))
    t = F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") * F.col("ic")))
    return g.withColumn("t_stat", F.when((F.col("n") > 2) & (F.abs("ic") < 1), t))


def newey_west_t(series: Series, x: str, lag: int) -> DataFrame:
    """t of the mean with Bartlett weights: lag products are columns of one aggregate."""
    d = series.columns(lambda fr: {f"__x{k}": F.lag(x, k).over(fr.w()) for k in range(1, lag + 1)}, back_rows=lag)
    keys = list(series.key)
    cols = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.sum(F.col(x) * F.col(x)).alias("__s0"), F.sum(x).alias("__sum")]
    for k in range(1, lag + 1):
        both = F.col(f"__x{k}").isNotNull()
        cols += [F.sum(F.col(x) * F.col(f"__x{k}")).alias(f"__p{k}"), F.sum(F.when(both, F.col(x))).alias(f"__u{k}"),
                 F.sum(F.col(f"__x{k}")).alias(f"__v{k}"), F.count(f"__x{k}").alias(f"__c{k}")]
    g = d.groupBy(*keys).agg(*cols)
    m, n = F.col("mean"), F.col("n")

    def gamma(k):
        if k == 0:
            return (F.col("__s0") - n * m * m) / n
        return (F.col(f"__p{k}") - m * (F.col(f"__u{k}") + F.col(f"__v{k}")) + F.col(f"__c{k}") * m * m) / n

    var = gamma(0)
    for k in range(1, lag + 1):
        var = var + 2.0 * (1.0 - k / (lag + 1.0)) * gamma(k)
    return g.select(*keys, "n", "mean", F.when(var > 0, m / F.sqrt(var / n)).alias("t_stat"))


def block_ic(df: DataFrame, x: str, y: str, block: Column, min_rows: int = 3) -> DataFrame:
    """t-statistic of the per-block correlations."""
    per = df.groupBy(block.alias("__b")).agg(F.corr(x, y).alias("__ic"), F.count(F.lit(1)).alias("__n")).filter(
        (F.col("__n") >= min_rows) & F.col("__ic").isNotNull() & ~F.isnan("__ic"))
    g = per.agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("__ic").alias("mean_ic"), F.stddev_samp("__ic").alias("__s"))
    return g.select("n_blocks", "mean_ic", F.when(F.col("__s") > 0, F.col("mean_ic") / (F.col("__s") / F.sqrt("n_blocks"))).alias("t_stat"))


def p_value(exceed: Column, n: Column | int, corrected: bool = True) -> Column:
    total = F.lit(n) if isinstance(n, int) else n
    return (exceed + 1) / (total + 1) if corrected else exceed / total


def sign_flip_p(df: DataFrame, x: str, ids: Sequence[str], n: int, seed: int, by: str | Sequence[str] | None = None) -> DataFrame:
    """Two-sided p of the mean against random signs.

    One 64-bit hash gives the signs of 64 replicates, so a row is expanded
    n/64-fold inside the map task and only sums are shuffled.
    """
    keys = as_list(by)
    words = math.ceil(n / 64)
    d = df.filter(F.col(x).isNotNull()).withColumn("__w", F.explode(F.sequence(F.lit(0), F.lit(words - 1))))
    d = d.withColumn("__h", F.xxhash64(F.lit(seed), F.col("__w"), *[F.col(i) for i in ids]))
    sums = [F.sum(F.when(F.shiftrightunsigned("__h", b).bitwiseAND(F.lit(1)) == 1, F.col(x)).otherwise(-F.col(x))).alias(f"s{b}") for b in range(64)]
    g = d.groupBy(*keys, "__w").agg(F.sum(x).alias("__real"), F.count(F.lit(1)).alias("__n"), *sums)
    rep = g.select(*keys, "__w", "__real", "__n", F.posexplode(F.array(*[f"s{b}" for b in range(64)])).alias("__b", "__s"))
    rep = rep.filter(F.col("__w") * 64 + F.col("__b") < n)
    out = rep.groupBy(*keys).agg(
        (F.max("__real") / F.max("__n")).alias("mean"), F.max("__n").alias("n"),
        F.count_if(F.abs("__s") >= F.abs("__real")).alias("__e"), F.count(F.lit(1)).alias("__r"))
    return out.select(*keys, "mean", "n", p_value(F.col("__e"), F.col("__r")).alias("p_value"))


def permutation_p(df: DataFrame, key: str, ts: str, x: str, score: Column, mode: str = "entities", n: int = 200, seed: int = 7, block_us: int | None = None, corrected: bool = True, tail: str = "upper") -> DataFrame:
    """Permutation null of an aggregate score.

    ``score`` is an aggregate over a column named ``x_perm`` and others of the
    table.  ``mode``: ``entities`` permutes x among keys within each instant,
    ``time`` permutes x in time within each key, ``blocks`` permutes contiguous
    blocks of ``block_us``, in one order for all keys of a replicate, so that what
    keys share at an instant stays together. ``tail`` is ``upper`` or ``both``.
    """
    rows = df.filter(F.col(x).isNotNull())
    real = rows.withColumn("x_perm", F.col(x)).agg(score.alias("real"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")
    if mode in ("entities", "time"):
        group, member = (ts, key) if mode == "entities" else (key, ts)
        # numbered once; a replicate's partner slot is computed, so nothing is sorted for it
        slots = Series(rows, [group], [member]).numbered("__slot").withColumn("__slot", F.col("__slot") - 1)
        slots = materialize(slots, "slots")
        sizes = slots.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
        base = slots.join(sizes, group).select("*", reps)
        base = base.withColumn("__partner", permuted(F.col("__slot"), F.col("__size"), F.lit(seed), F.col("rep"), F.col(group)))
        moved = slots.select(F.col(group).alias("__group"), F.col("__slot").alias("__from"), F.col(x).alias("x_perm"))
        perm = base.join(moved, (F.col(group) == F.col("__group")) & (F.col("__partner") == F.col("__from")))
    else:
        # a block keeps its inside order; only the block order is drawn
        blk = F.floor(F.unix_micros(ts) / block_us)
        d = Series(rows.withColumn("__blk", blk), [key, "__blk"], [ts]).numbered("__i")
        sizes = d.groupBy(key, "__blk").agg(F.count(F.lit(1)).alias("__len"))
        drawn = sizes.select("*", reps).withColumn("__u", hash_uniform([F.lit(seed), "rep", "__blk"], seed))
        placed = Series(drawn, ["rep", key], ["__u", "__blk"]).running({"__end": ("sum", F.col("__len"))})
        moved = d.select(key, "__blk", "__i", F.col(x).alias("x_perm")).join(placed, [key, "__blk"]).select(
            "rep", key, (F.col("__end") - F.col("__len") + F.col("__i")).alias("__slot"), "x_perm")
        slots = Series(rows, [key], [ts]).numbered("__slot").select("*", reps)
        perm = slots.join(moved, ["rep", key, "__slot"])
    null = perm.groupBy("rep").agg(score.alias("null"))
    j = null.join(F.broadcast(real))  # one row
    beyond = F.abs("null") >= F.abs("real") if tail == "both" else F.col("null") >= F.col("real")
    return j.agg(F.max("real").alias("real"), F.avg("null").alias("null_mean"), F.count(F.lit(1)).alias("n"),
                 F.count_if(beyond).alias("__e")).select(
        "real", "null_mean", "n", p_value(F.col("__e"), F.col("n"), corrected).alias("p_value"))


def block_bootstrap(series: Series, x: str, block: int, n: int, stat: str = "mean", seed: int = 7, scale: float = 1.0) -> DataFrame:
    """Circular block bootstrap interval of the mean or the mean/std ratio.

    Every block sum is the difference of two prefix sums, so drawn blocks are
    two look-ups each and no row is duplicated.
    """
    pref = series.running({"__i": ("count", F.lit(1)), "__p1": ("sum", F.col(x)), "__p2": ("sum", F.col(x) * F.col(x))}).select("__i", "__p1", "__p2")
    pref = materialize(pref, "prefix")
    total = pref.agg(F.max("__i").alias("__n"), F.max_by("__p1", "__i").alias("__t1"), F.max_by("__p2", "__i").alias("__t2"))
    # replicates are drawn side by side
    draws = series.df.sparkSession.range(n).select(F.col("id").cast("int").alias("rep")).join(F.broadcast(total)).select(  # one row
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__n") / block) - 1)).alias("__k"))
    u = hash_uniform([F.lit(seed), "rep", "__k"], seed)
    draws = draws.withColumn("__a", F.floor(u * F.col("__n"))).withColumn(
        "__len", F.least(F.lit(block).cast("long"), F.col("__n") - F.col("__k") * block))
    draws = draws.withColumn("__z", F.col("__a") + F.col("__len")).withColumn("__wrap", F.col("__z") > F.col("__n"))
    draws = draws.withColumn("__z", F.when(F.col("__wrap"), F.col("__z") - F.col("__n")).otherwise(F.col("__z")))
    zero = total.select(F.lit(0).cast("long").alias("__i"), F.lit(0.0).alias("__p1"), F.lit(0.0).alias("__p2"))
    pts = pref.unionByName(zero)
    j = draws.join(pts.select(F.col("__i").alias("__a"), F.col("__p1").alias("__a1"), F.col("__p2").alias("__a2")), "__a").join(
        pts.select(F.col("__i").alias("__z"), F.col("__p1").alias("__z1"), F.col("__p2").alias("__z2")), "__z")
    s1 = F.col("__z1") - F.col("__a1") + F.when(F.col("__wrap"), F.col("__t1")).otherwise(0.0)
    s2 = F.col("__z2") - F.col("__a2") + F.when(F.col("__wrap"), F.col("__t2")).otherwise(0.0)
    g = j.groupBy("rep").agg(F.sum(s1).alias("__s1"), F.sum(s2).alias("__s2"), F.max("__n").alias("__n"))
    mean = F.col("__s1") / F.col("__n")
    var = (F.col("__s2") - F.col("__n") * mean * mean) / (F.col("__n") - 1)
    value = mean if stat == "mean" else F.when(var > 0, mean / F.sqrt(var))
    reps = g.select((value * scale).alias("v"))
    out = group_quantiles(reps, None, "v", {"lo": 0.025, "mid": 0.5, "hi": 0.975}, "n_reps")
    t = total.select((F.col("__t1") / F.col("__n")).alias("__m"), ((F.col("__t2") - F.col("__t1") * F.col("__t1") / F.col("__n")) / (F.col("__n") - 1)).alias("__v"))
    real = t.select((scale * (F.col("__m") if stat == "mean" else F.col("__m") / F.sqrt("__v"))).alias("real"))
    return out.join(F.broadcast(real))  # one row


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count from a uniform by its distribution function."""
    cdf, term, out, k = 0.0, math.exp(-1.0), None, 0
    while cdf + term > cdf:  # until the steps are below what a double tells apart
        cdf += term
        out = F.when(u < cdf, F.lit(k)) if out is None else out.when(u < cdf, F.lit(k))
        k += 1
        term /= k
    return out.otherwise(F.lit(k))


def group_bootstrap(df: DataFrame, x: str, unit: Column, n: int, seed: int = 7) -> DataFrame:
    """Interval of the mean when whole days (weeks) are resampled with Poisson weights."""
    groups = df.filter(F.col(x).isNotNull()).groupBy(unit.alias("__g")).agg(F.sum(x).alias("__s"), F.count(x).alias("__c"))
    reps = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    w = poisson_weight(hash_uniform([F.lit(seed), "rep", "__g"], seed))
    g = reps.groupBy("rep").agg(F.sum(w * F.col("__s")).alias("__s"), F.sum(w * F.col("__c")).alias("__c"))
    vals = g.filter(F.col("__c") > 0).select((F.col("__s") / F.col("__c")).alias("v"))
    return group_quantiles(vals, None, "v", {"lo": 0.025, "mid": 0.5, "hi": 0.975}, "n_reps")


def folds(df: DataFrame, order: Sequence[str], n: int, name: str = "fold") -> DataFrame:
    """Chronological folds of equal size over the whole table."""
    return ntile_labels(df, None, order, n, name)


def is_oos(df: DataFrame, order: Sequence[str], frac: float, name: str = "split") -> DataFrame:
    """First ``frac`` of rows in time are in-sample."""
    s = Series(df, None, list(order))
    numbered = s.numbered("__rn")
    total = s.df.agg(F.count(F.lit(1)).alias("__t"))
    j = numbered.join(F.broadcast(total))  # one row
    return j.withColumn(name, F.when(F.col("__rn") <= F.floor(F.col("__t") * frac), F.lit("IS")).otherwise(F.lit("OOS"))).drop("__rn", "__t")


def purged_folds(df: DataFrame, ts: str, n: int, embargo_us: int) -> DataFrame:
    """Expanding train rows with an embargo before each test fold: (fold, role) per row.

    Fold bounds are n evenly spaced instants; each row meets the few folds it
    takes part in through a literal array.
    """
    span = df.agg(F.min(F.unix_micros(ts)).alias("__a"), F.max(F.unix_micros(ts)).alias("__b"))
    d = df.join(F.broadcast(span)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))  # one row
    width = (F.col("__b") - F.col("__a") + 1) / (n + 1.0)
    lo = F.col("__a") + width * F.col("fold")
    us = F.unix_micros(ts)
    role = F.when((us >= lo) & (us < lo + width), F.lit("test")).when(us < lo - embargo_us, F.lit("train"))
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).drop("__a", "__b")


def drop_one(df: DataFrame, unit: Column, x: str) -> DataFrame:
    """Mean and deviation without each unit: totals minus the unit's own moments."""
    per = df.groupBy(unit.alias("dropped")).agg(F.count(x).alias("__n"), F.sum(x).alias("__s"), F.sum(F.col(x) * F.col(x)).alias("__q"))
    tot = per.agg(F.sum("__n").alias("__tn"), F.sum("__s").alias("__ts"), F.sum("__q").alias("__tq"))
    j = per.join(F.broadcast(tot))  # one row
    n, s, q = F.col("__tn") - F.col("__n"), F.col("__ts") - F.col("__s"), F.col("__tq") - F.col("__q")
    return j.select("dropped", n.alias("n"), F.when(n > 0, s / n).alias("mean"), F.when(n > 1, F.sqrt((q - s * s / n) / (n - 1))).alias("std"))


def gate_table(spark, gates: dict[str, tuple[DataFrame, str, Callable[[Column], Column]]]) -> DataFrame:
    """One pass/fail row per gate: (table, value column, rule)."""
    out = None
    for name, (df, col, rule) in gates.items():
        row = df.select(F.lit(name).alias("gate"), F.col(col).cast("double").alias("value"), rule(F.col(col)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def pinball(y: Column, yhat: Column, q: float) -> Column:
    return F.greatest(q * (y - yhat), (q - 1) * (y - yhat))


def climatology(train: DataFrame, by: Sequence[str], y: str, q: float, name: str = "yhat") -> DataFrame:
    return group_quantiles(train, by, y, {name: q})


def log_factorial(m: Column) -> Column:
    """Natural logarithm of m!: exact sums up to 20, Stirling's series (error below 1e-12) beyond."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    x = m.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(m <= 20, F.get(small, m.cast("int"))).otherwise(series)


def binomial_tail(hits: Column, n: Column, p: float) -> Column:
    """P(X >= hits) of a binomial(n, p), summed away from the centre: upwards from ``hits`` above
    the mean, else one less the lower tail. Terms fall off after a few standard deviations,
    so the number added follows the root of n."""
    if p >= 1.0:
        return F.lit(1.0)
    hits, n = hits.cast("long"), n.cast("long")
    above = hits > n * p
    first = F.when(above, hits).otherwise(hits - 1)
    reach = F.ceil(40 * F.sqrt(n * p * (1 - p)) + 100).cast("long")
    last = F.when(above, F.least(n, first + reach)).otherwise(F.greatest(F.lit(0).cast("long"), first - reach))
    start = log_factorial(n) - log_factorial(first) - log_factorial(n - first) + first * math.log(p) + (n - first) * math.log1p(-p)
    up = lambda k: F.log((n - k + 1) / k) + math.log(p) - math.log1p(-p)  # noqa: E731  from k - 1 to k
    down = lambda k: F.log((k + 1) / (n - k)) + math.log1p(-p) - math.log(p)  # noqa: E731  from k + 1 to k

    def add(acc: Column, k: Column) -> Column:
        term = F.when(k == first, acc["term"]).when(above, acc["term"] + up(k)).otherwise(acc["term"] + down(k))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    total = F.aggregate(F.sequence(first, last), F.struct(start.alias("term"), F.lit(0.0).alias("total")), add, lambda acc: acc["total"])
    return F.when(hits <= 0, 1.0).otherwise(F.when(above, total).otherwise(1.0 - total))


def break_even(df: DataFrame, by, tp: float, sl: float, cost: float, label: str = "label") -> DataFrame:
    """Break-even hit share, observed share, its z, and the exact upper-tail binomial probability."""
    p0 = (sl + cost) / (tp - cost + sl + cost)
    g = df.filter(F.col(label) != 0).groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("hits"))
    z = (F.col("hits") - F.col("n") * p0) / F.sqrt(F.col("n") * p0 * (1 - p0))
    return g.select(*as_list(by), "n", "hits", F.lit(p0).alias("p_star"), (F.col("hits") / F.col("n")).alias("p_hat"), z.alias("z"),
                    binomial_tail(F.col("hits"), F.col("n"), min(p0, 1.0)).alias("p_value"))


def check_causal(op: Callable[[DataFrame], DataFrame], df: DataFrame, ts: str, cut: Column) -> DataFrame:
    """Rows up to ``cut`` that change when later rows are removed; empty for a causal operator."""
    whole = op(df).filter(F.col(ts) <= cut)
    short = op(df.filter(F.col(ts) <= cut))
    return whole.exceptAll(short).unionAll(short.exceptAll(whole))


def equity_paths(ledger: DataFrame, pnl: str, order: Sequence[str], n: int, horizon: int, seed: int = 7) -> DataFrame:
    """Quartiles of final return and worst drawdown over resampled trade sequences."""
    s = Series(ledger.select(*order, pnl), None, list(order))
    trades = s.numbered("__i").select((F.col("__i") - 1).alias("__pick"), F.col(pnl).alias("__x"))
    size = s.df.agg(F.count(F.lit(1)).alias("__t"))
    draws = size.select("__t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")).select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__k"))
    draws = draws.withColumn("__pick", F.floor(hash_uniform([F.lit(seed), "rep", "__k"], seed) * F.col("__t")))
    if n * horizon <= DEFAULT_BROADCAST_ROWS:
        draws = F.broadcast(draws)  # n * horizon rows: the numbered trades do not move
    seq = materialize(draws.join(trades, "__pick").select("rep", "__k", "__x"), "paths")
    eq = Series(seq, "rep", ["__k"], bounded_rows=horizon)
    eq = eq.with_df(eq.running({"__eq": ("sum", F.col("__x"))}))
    dd = eq.running({"__peak": ("max", F.col("__eq"))})
    per = dd.groupBy("rep").agg(F.max_by("__eq", "__k").alias("final"), F.min(F.col("__eq") - F.greatest(F.col("__peak"), F.lit(0.0))).alias("drawdown"))
    a = group_quantiles(per, None, "final", {"final_p25": 0.25, "final_p50": 0.5, "final_p75": 0.75}, "n_reps")
    b = group_quantiles(per, None, "drawdown", {"dd_p25": 0.25, "dd_p50": 0.5, "dd_p75": 0.75})
    return a.join(F.broadcast(b))  # one row


def select_then_confirm(results: DataFrame, by: Sequence[str], config: Sequence[str], score: str, split: str = "split") -> DataFrame:
    """Best configuration per key in-sample joined to its out-of-sample score."""
    isr = results.filter(F.col(split) == "IS")
    best = isr.groupBy(*by).agg(F.max(F.struct(F.col(score).alias("is_score"), *config)).alias("__b")).select(*by, "__b.*")
    oos = results.filter(F.col(split) == "OOS").select(*by, *config, F.col(score).alias("oos_score"))
    return best.join(oos, [*by, *config], "left")
