"""Cost profiles and trade-ledger analytics.

Curves run per (group, day) wherever the question allows, because a day of
trades pre-aggregates map-side; per-trade curves use the block carry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import DAY_US, HOUR_US, hour_of_week, local_instant
from barline.functions.scalar import clip
from barline.operators.aggregates import cut
from barline.operators.asof import asof
from barline.operators.cleaning import random_k
from barline.operators.joins import signed_explode
from barline.operators.ordering import circular_extreme
from barline.plans.quantiles import group_quantiles
from barline.plans.rangejoin import point_in_interval
from barline.plans.series import BROADCAST_ROWS_CONF, DEFAULT_BROADCAST_ROWS, Series, as_list
from barline.sources.sinks import materialize


def cost_profile(df: DataFrame, key, cost: str, ts: str = "ts", liquid_share: float = 0.5) -> DataFrame:
    """p25/p50/p75/n of cost per hour of week; liquid when n is a share of the busiest hour."""
    keys = as_list(key)
    prof = group_quantiles(df.withColumn("how", hour_of_week(ts)), [*keys, "how"], cost, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "n")
    busiest = prof.groupBy(*keys).agg(F.max("n").alias("__mx"))
    return prof.join(busiest, keys).withColumn("liquid", F.col("n") >= liquid_share * F.col("__mx")).drop("__mx")


def cheapest_window(profile: DataFrame, key, width: int = 8, slots: int = 24) -> DataFrame:
    """Cheapest and dearest circular window of the day and the saving between them."""
    keys = as_list(key)
    hourly = profile.groupBy(*keys, F.pmod("how", F.lit(slots)).alias("slot")).agg(F.avg("p50").alias("v"))
    lo = circular_extreme(hourly, keys, "slot", "v", width, slots).select(*keys, F.col("best_slot").alias("cheap_slot"), F.col("best_value").alias("cheap"))
    hi = circular_extreme(hourly, keys, "slot", "v", width, slots, largest=True).select(*keys, F.col("best_slot").alias("dear_slot"), F.col("best_value").alias("dear"))
    return lo.join(hi, keys).withColumn("saving", F.col("dear") - F.col("cheap"))


def equity_curve(ledger: DataFrame, by, order: Sequence[str], pnl: str = "pnl") -> DataFrame:
    return Series(ledger, by, list(order)).running({"equity": ("sum", F.col(pnl)), "trade_no": ("count", F.lit(1))})


def daily_curve(ledger: DataFrame, by, ts: str = "exit_time", pnl: str = "pnl") -> DataFrame:
    keys = as_list(by)
    d = ledger.groupBy(*keys, F.date_trunc("day", ts).alias("day")).agg(F.sum(pnl).alias("pnl"), F.count(F.lit(1)).alias("n"))
    d = materialize(d, "daily")  # small, and callers read it in several branches
    return Series(d, keys, ["day"]).running({"equity": ("sum", F.col("pnl"))})


def max_drawdown(curve: DataFrame, by, order: Sequence[str], equity: str = "equity") -> DataFrame:
    """Worst fall from the running peak (the start counts as 0)."""
    keys = as_list(by)
    d = Series(curve, keys, list(order)).running({"__peak": ("max", F.col(equity))})
    fall = F.col(equity) - F.greatest(F.col("__peak"), F.lit(0.0))
    return d.groupBy(*keys).agg(F.min(fall).alias("max_drawdown"), F.max_by(equity, F.struct(*order)).alias("final"))


def rolling_perf(ledger: DataFrame, by, order: Sequence[str], n: int, pnl: str = "pnl", lo: float = 0.0, hi: float = 0.5) -> DataFrame:
    """Sharpe, expectancy in average losses, and a linear gate from the last n trades of each group."""
    keys = as_list(by)
    last = Series(ledger, keys, list(order)).running({"__r": ("count", F.lit(1))}, reverse=True).filter(F.col("__r") <= n)
    p = F.col(pnl)
    g = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("__s"), F.avg(F.when(p < 0, -p)).alias("__l"))
    g = g.withColumn("sharpe", F.when(F.col("__s") > 0, F.col("mean") / F.col("__s"))).withColumn("expectancy_r", F.when(F.col("__l") > 0, F.col("mean") / F.col("__l")))
    return g.withColumn("gate", clip((F.col("expectancy_r") - lo) / (hi - lo), 0.0, 1.0)).drop("__s", "__l")


def blend(prior: Column, live: Column, n: Column, halflife: float) -> Column:
    """Weight 0.5**(n/halflife) on the prior, the rest on live figures."""
    w = F.pow(F.lit(0.5), n / halflife)
    return F.when(live.isNull(), prior).otherwise(w * prior + (1 - w) * live)


def drawdown_taper(daily: DataFrame, by, equity: str, start: float, limit: float, order: str = "day") -> DataFrame:
    """Scale from 1 at ``start`` to 0 at ``limit`` of the fall from the running high."""
    d = Series(daily, by, [order]).running({"high_water": ("max", F.col(equity))})
    fall = F.when(F.col("high_water") > 0, (F.col("high_water") - F.col(equity)) / F.col("high_water")).otherwise(0.0)
    return d.withColumn("drawdown", fall).withColumn("scale", clip((limit - F.col("drawdown")) / (limit - start), 0.0, 1.0))


def exposure(positions: DataFrame, bridge: DataFrame, key: str, notional: str, nav: float, cap: float) -> DataFrame:
    """Net signed notional per entity over NAV, position count, and whether it is over the cap."""
    ex = signed_explode(positions, bridge, key)
    g = ex.groupBy("entity").agg(F.sum(F.col("sign") * F.col(notional)).alias("net"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("net") / nav).withColumn("blocked", F.abs(F.col("net") / nav) > cap)


def tripwire(ledger: DataFrame, by, min_n: int, since: str, ts: str = "exit_time", pnl: str = "pnl") -> DataFrame:
    """Groups with at least min_n trades since a date and a negative total."""
    return ledger.filter(F.col(ts) >= since).groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("total")).filter(
        (F.col("n") >= min_n) & (F.col("total") < 0))


def equity_switch(daily: DataFrame, by, w: int, order: str = "day") -> DataFrame:
    """On when yesterday's equity stood above its own w-day mean; switched curve beside the plain one."""
    keys = as_list(by)

    def stage(d, fr):
        d = d.withColumn("__m", F.when(F.count("equity").over(fr.last_n(w)) == w, F.avg("equity").over(fr.last_n(w))))
        d = d.withColumn("__on", F.when(F.col("__m").isNull(), 1).otherwise((F.col("equity") > F.col("__m")).cast("int")))
        return d.withColumn("is_on", F.coalesce(F.lag("__on").over(fr.w()), F.lit(1))).drop("__m", "__on")

    s = Series(daily, keys, [order])
    d = s.with_df(s.map(stage, back_rows=w + 1))
    return d.running({"switched_equity": ("sum", F.col("is_on") * F.col("pnl"))})


def monthly_allocation(daily: DataFrame, group: str, w: int, k: int, order: str = "day", seed: int = 7) -> DataFrame:
    """Each month: top-k groups by the last w days before it (equal weights), all eligible, and a random k.

    Scores come from rows before the month start only.
    """
    d = Series(daily, group, [order]).columns(lambda fr: {"__sc": F.sum("pnl").over(fr.last_n(w)), "__n": F.count("pnl").over(fr.last_n(w))}, back_rows=w)
    scored = d.filter(F.col("__n") == w).select(group, F.col(order).alias("available_at"), F.col("__sc").alias("score"))
    months = daily.groupBy(group, F.date_trunc("month", order).alias("month")).agg(F.sum("pnl").alias("month_pnl"))
    el = asof(months, scored, group, left_ts="month", strict=True).filter(F.col("score").isNotNull())
    ranked = Series(el.withColumn("__neg", -F.col("score")), "month", ["__neg", group]).numbered("__rk")
    picked = random_k(el, "month", ["month", group], k, seed).select("month", group, F.lit(1).alias("__rnd"))
    j = ranked.join(picked, ["month", group], "left")
    return j.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_eligible"), F.avg("month_pnl").alias("equal_pnl"),
        F.avg(F.when(F.col("__rk") <= k, F.col("month_pnl"))).alias("selected_pnl"), F.avg(F.when(F.col("__rnd") == 1, F.col("month_pnl"))).alias("random_pnl"))


def peak_concurrency(intervals: DataFrame, by, start: str, end: str) -> DataFrame:
    """Most intervals open at once; one ending as another begins still counts as open."""
    keys = as_list(by)
    ev = intervals.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("o"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(1).alias("o"), F.lit(-1).alias("d")))).alias("e"))
    # equal instants are combined before the scan
    net = ev.groupBy(*keys, "e.t", "e.o").agg(F.sum("e.d").alias("d"))
    run = Series(net, keys, ["t", "o"]).running({"open_now": ("sum", F.col("d"))})
    return run.groupBy(*keys).agg(F.max("open_now").alias("peak"))


def occupancy(intervals: DataFrame, by, start: str, end: str, width_us: int = DAY_US) -> DataFrame:
    """Slots with at least one open interval, mean and highest stacking, share of trades opened while flat.

    A sweep over opening and closing slots: nothing is expanded per slot held.
    """
    keys = as_list(by)

    def slot(c: str) -> Column:
        return F.floor(F.unix_micros(c) / width_us)

    moves = F.array(F.struct(slot(start).alias("s"), F.lit(1).alias("d")), F.struct((slot(end) + 1).alias("s"), F.lit(-1).alias("d")))
    net = intervals.select(*keys, F.explode(moves).alias("m")).groupBy(*keys, "m.s").agg(F.sum("m.d").alias("d"))
    s = Series(net, keys, ["s"])
    s = s.with_df(s.running({"__open": ("sum", F.col("d"))}))
    run = s.columns(lambda fr: {"__len": F.lead("s").over(fr.w()) - F.col("s")}, fwd_rows=1).filter("__open > 0")
    occ = run.groupBy(*keys).agg(
        F.sum("__len").alias("slots_used"), (F.sum(F.col("__open") * F.col("__len")) / F.sum("__len")).alias("mean_stack"), F.max("__open").alias("max_stack"))
    day = intervals.groupBy(*keys, F.col(start).alias("__t")).agg(F.max(end).alias("__e"), F.count(F.lit(1)).alias("__n"))
    prior = Series(day, keys, ["__t"]).running({"__until": ("max", F.col("__e"))}, exclusive=True)
    flat = F.col("__until").isNull() | (F.col("__until") < F.col("__t"))
    novel = prior.groupBy(*keys).agg((F.sum(F.when(flat, 1).otherwise(0)) / F.sum("__n")).alias("novel_share"))
    return occ.join(novel, keys)


def book_correlation(daily: DataFrame, group: str, books: Sequence[str], order: str = "day") -> DataFrame:
    """Correlation of the daily results of each listed pair of books; an idle day counts 0."""
    wide = daily.groupBy(order).agg(*[F.coalesce(F.sum(F.when(F.col(group) == b, F.col("pnl"))), F.lit(0.0)).alias(f"b{i}") for i, b in enumerate(books)])
    pairs = [(i, j) for i in range(len(books)) for j in range(i + 1, len(books))]
    row = wide.agg(*[F.corr(f"b{i}", f"b{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(books[i]).alias("a"), F.lit(books[j]).alias("b"), F.col(f"c{i}_{j}").alias("corr")) for i, j in pairs])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def excursion_ratios(df: DataFrame, pnl: str, mfe: str, mae: str) -> DataFrame:
    return df.withColumn("capture_ratio", F.when(F.col(mfe) > 0, F.col(pnl) / F.col(mfe))).withColumn(
        "pnl_over_mae", F.when(F.col(mae) < 0, F.col(pnl) / -F.col(mae)))


#: Width of the cells of time in which bars are looked for.
CELL_US = HOUR_US


def at_next_bar(rows: DataFrame, at: str, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``at`` moved up to the first bar of their key at or after it, or, if their
    cell of time has none, to the end of the cell. What a bar sees as of its time stays the
    same, and rows have no more instants than there are bars and cells."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda c: us(c) - F.pmod(us(c), F.lit(CELL_US))
    stops = bars.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], cell("ts").alias("__k")).agg(
        F.sort_array(F.collect_set("ts")).alias("__stops"))
    stops = materialize(stops, "stops")
    if stops.count() <= int(rows.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS))):
        stops = F.broadcast(stops)
    cond = cell(at) == F.col("__k")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    end = F.timestamp_micros(cell(at) + F.lit(CELL_US)).cast(rows.schema[at].dataType)
    moved = F.coalesce(F.get(F.filter("__stops", lambda s: s >= F.col(at)), F.lit(0)), end)
    return rows.join(stops, cond, "left").select(*[moved.alias(c) if c == at else F.col(c) for c in rows.columns])


def floating_equity(ledger: DataFrame, bars: DataFrame, key: str, entry: str, exit_: str, width_us: int) -> DataFrame:
    """Open trades marked on bars plus realised results, one total per bar time.

    ``ledger``: key, entry/exit times, entry_price, side, pnl; longs are marked at
    bid_c, shorts at ask_c.  A trade's mark counts from its entry until its exit;
    the realised part is a running sum of exits per instant.

    A book is known from running sums: trades open and their entry value, for each key and
    side, change at entries and exits only. A bar looks them up as of its time and marks
    them at once, so there is no row per open trade and bar. Changes are added up over the
    time from one bar to the next before anything is sorted, so what is sorted follows the
    bars.
    """
    bars = materialize(bars.select(key, "ts", "bid_c", "ask_c"), "marks")  # for marks, stops and times
    times = bars.select("ts").distinct()
    long, price = F.col("side") > 0, F.col("entry_price")
    priced = F.when(price.isNotNull(), 1).otherwise(0)
    book = {"__open": F.lit(1), "__longs": F.when(long, priced).otherwise(0), "__shorts": F.when(long, 0).otherwise(priced),
            "__paid": F.when(long, price).otherwise(-price)}
    lasting = ledger.filter(F.col(entry) < F.col(exit_))
    changes = lasting.select(key, F.explode(F.array(*[
        F.struct(F.col(at).alias("__at"), *[(F.lit(sign) * c).cast("double").alias(n) for n, c in book.items()]) for at, sign in ((entry, 1), (exit_, -1))
    ])).alias("c")).select(key, "c.*")
    changes = at_next_bar(changes, "__at", bars, [key]).groupBy(key, "__at").agg(*[F.sum(n).alias(n) for n in book])
    held = Series(changes, key, ["__at"]).running({f"{n}_now": ("sum", F.coalesce(F.col(n), F.lit(0.0))) for n in book}).drop(*book)
    marks = asof(bars, held, key, right_ts="__at")
    part = lambda n, at: F.when(F.col(n) != 0, F.col(n) * F.col(at)).otherwise(F.lit(0.0))
    mark = part("__longs_now", "bid_c") - part("__shorts_now", "ask_c") - F.col("__paid_now")
    open_now = marks.groupBy("ts").agg(F.sum(mark).alias("floating"), F.sum("__open_now").cast("long").alias("n_open"))
    closed = ledger.filter(F.col(exit_).isNotNull()).select(F.col(exit_).alias("available_at"), "pnl")
    closed = at_next_bar(closed, "available_at", times, []).groupBy("available_at").agg(F.sum("pnl").alias("__p"))
    realised = Series(closed, None, ["available_at"]).running({"realised": ("sum", F.col("__p"))}).drop("__p")
    d = asof(times, realised, None).join(open_now, "ts", "left")
    return d.select("ts", F.coalesce("floating", F.lit(0.0)).alias("floating"), F.coalesce("realised", F.lit(0.0)).alias("realised"),
                    F.coalesce("n_open", F.lit(0)).alias("n_open"), (F.coalesce("floating", F.lit(0.0)) + F.coalesce("realised", F.lit(0.0))).alias("equity"))


# fixed values: rollover days booked at the close of Monday..Sunday
ROLLOVER_DAYS = (1, 1, 3, 1, 1, 0, 0)


CALENDAR_DAYS = 366 * 300


def financing(ledger: DataFrame, rates: DataFrame, ids: Sequence[str], entry: str, exit_: str, units: str, tz: str = "America/New_York", hour: int = 17) -> DataFrame:
    """Units times the daily charges of all rollovers in (entry, exit].

    Charges are summed once along the calendar; a trade takes the difference of
    the running total at its two ends, so holding time costs nothing.
    """

    def last_rollover(c: str) -> Column:
        return F.to_date(F.from_utc_timestamp(F.col(c), tz) - F.expr(f"INTERVAL {hour} HOURS"))

    led = ledger.select(*dict.fromkeys([*ids, units]), last_rollover(entry).alias("__d0"), last_rollover(exit_).alias("__d1"))
    led = materialize(led, "rollovers")  # for the span and for the charges
    span = led.agg(F.min("__d0").alias("a"), F.max("__d1").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("__d")).withColumn("__roll", local_instant("__d", tz, hour))
    table = F.array(*[F.lit(x) for x in ROLLOVER_DAYS])
    priced = asof(days, rates, None, left_ts="__roll").withColumn(
        "__c", F.coalesce(F.col("rate") / 365.0 * F.get(table, F.weekday("__d")), F.lit(0.0)))
    cum = Series(priced, None, ["__d"], bounded_rows=CALENDAR_DAYS).running({"__cum": ("sum", F.col("__c"))})

    def at(day: str, name: str) -> DataFrame:
        return F.broadcast(cum.select(F.col("__d").alias(day), F.col("__cum").alias(name)))  # a calendar's days

    j = led.join(at("__d0", "__a"), "__d0").join(at("__d1", "__z"), "__d1")
    return j.select(*ids, (F.col(units) * (F.col("__z") - F.col("__a"))).alias("financing"), F.date_diff("__d1", "__d0").alias("n_rollovers"))


def reprice(ledger: DataFrame, scenarios: Sequence[dict[str, float]], cost_base: Column, by) -> DataFrame:
    """Net totals under alternative cost levels; scenarios are a literal array exploded per group sum."""
    g = ledger.groupBy(*as_list(by)).agg(F.sum("pnl").alias("gross"), F.sum(cost_base).alias("base"), F.count(F.lit(1)).alias("n"))
    arr = F.array(*[F.struct(F.lit(s["name"]).alias("scenario"), F.lit(float(s["cost"])).alias("cost")) for s in scenarios])
    return g.select("*", F.explode(arr).alias("s")).select(*as_list(by), "s.scenario", "n", (F.col("gross") - F.col("s.cost") * F.col("base")).alias("net"))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-9) -> DataFrame:
    """Full outer comparison: only_a, only_b, changed, same; value falls back to b where a has none."""
    j = a.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__ia")).join(b.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__ib")), list(keys), "full")
    status = F.when(F.col("__ib").isNull(), "only_a").when(F.col("__ia").isNull(), "only_b").when(F.abs(F.col("__a") - F.col("__b")) > tol, "changed").otherwise("same")
    return j.select(*keys, status.alias("status"), F.coalesce("__a", "__b").alias("value"))


def compare_portfolios(daily: DataFrame, group: str, books: Sequence[str], n: int, seed: int = 7, order: str = "day") -> DataFrame:
    """Mean, deviation and ratio of equal, inverse-vol and random long-only weights.

    One aggregate row of means and covariances scores every weight vector.
    """
    from barline.operators.cleaning import hash_uniform

    m = len(books)
    wide = daily.groupBy(order).agg(*[F.coalesce(F.sum(F.when(F.col(group) == b, F.col("pnl"))), F.lit(0.0)).alias(f"b{i}") for i, b in enumerate(books)])
    row = wide.agg(*[F.avg(f"b{i}").alias(f"m{i}") for i in range(m)], *[F.covar_samp(f"b{i}", f"b{j}").alias(f"v{i}_{j}") for i in range(m) for j in range(i, m)])
    grid = row.select("*", F.explode(F.sequence(F.lit(-2), F.lit(n - 1))).alias("rep"))
    raw = [F.when(F.col("rep") == -2, 1.0).when(F.col("rep") == -1, 1.0 / F.sqrt(F.col(f"v{i}_{i}"))).otherwise(-F.log(F.lit(1.0) - hash_uniform([F.lit(seed), F.col("rep"), F.lit(i)], seed))) for i in range(m)]
    grid = grid.select("*", *[r.alias(f"w{i}") for i, r in enumerate(raw)])
    total = sum((F.col(f"w{i}") for i in range(m)), F.lit(0.0))
    mean = sum((F.col(f"w{i}") * F.col(f"m{i}") for i in range(m)), F.lit(0.0)) / total
    var = sum(((1 if i == j else 2) * F.col(f"w{i}") * F.col(f"w{j}") * F.col(f"v{i}_{j}") for i in range(m) for j in range(i, m)), F.lit(0.0)) / (total * total)
    kind = F.when(F.col("rep") == -2, "equal").when(F.col("rep") == -1, "inverse_vol").otherwise("random")
    return grid.select(kind.alias("kind"), F.col("rep"), mean.alias("mean"), F.sqrt(var).alias("std"), (mean / F.sqrt(var)).alias("ratio"))


def risk_ratios(daily: DataFrame, by, periods: float = 252.0, order: str = "day") -> DataFrame:
    keys = as_list(by)
    p = F.col("pnl")
    g = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(p) * periods).alias("ann_return"), (F.stddev_samp(p) * math.sqrt(periods)).alias("ann_vol"),
        F.sqrt(F.avg(F.pow(F.least(p, F.lit(0.0)), 2))).alias("__down"), F.avg((p > 0).cast("double")).alias("win_share"), F.max(p).alias("best"), F.min(p).alias("worst"))
    dd = max_drawdown(daily, keys, [order]).drop("final")
    j = g.join(dd, keys)
    return j.withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol"))).withColumn(
        "sortino", F.when(F.col("__down") > 0, F.col("ann_return") / (F.col("__down") * math.sqrt(periods)))).withColumn(
        "calmar", F.when(F.col("max_drawdown") < 0, F.col("ann_return") / -F.col("max_drawdown"))).drop("__down")


def holding_times(ledger: DataFrame, by, hours: Column, bounds: Sequence[float], labels: Sequence[str]) -> DataFrame:
    keys = as_list(by)
    cells = ledger.groupBy(*keys, cut(hours, bounds, labels).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("__t"))
    return cells.join(total, keys).select(*keys, "bucket", "n", (100.0 * F.col("n") / F.col("__t")).alias("pct"))


