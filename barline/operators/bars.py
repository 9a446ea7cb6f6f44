"""Clock, anchored, volume and tick-count bars; completed-bar projection; calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import DAY_US, HOUR_US, ceil_ts, floor_ts, local_instant, shift
from barline.operators.asof import asof
from barline.plans.series import Series, as_list


def ohlcv(order: Sequence[str], price: str = "price", volume: str | None = "volume") -> list[Column]:
    """Partial aggregates of a bar; first/last are min_by/max_by so they combine map-side."""
    pos = F.struct(*[F.col(c) for c in order])
    vol = F.sum(volume) if volume else F.count(F.lit(1))
    return [
        F.min_by(price, pos).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, pos).alias("close"),
        vol.cast("double").alias("volume"),
        F.count(F.lit(1)).alias("n_ticks"),
    ]


def resample(
    df: DataFrame,
    key: str | Sequence[str],
    width_us: int,
    order: Sequence[str] = ("ts", "tie"),
    price: str = "price",
    volume: str | None = "volume",
    closed: str = "left",
) -> DataFrame:
    """Fixed-interval OHLCV bars stamped at their open, known at ``available_at``.

    ``closed="right"`` builds (start, end] intervals stamped at their end.
    """
    keys = as_list(key)
    ts = order[0]
    if closed == "left":
        stamp = floor_ts(ts, width_us)
    else:
        stamp = ceil_ts(ts, width_us)
    known = shift("__b", width_us) if closed == "left" else F.col("__b")
    return (
        df.groupBy(*keys, stamp.alias("__b"))
        .agg(*ohlcv(order, price, volume))
        .select(*keys, F.col("__b").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks",
                known.alias("available_at"))
    )


def rebar(df: DataFrame, key: str | Sequence[str], width_us: int) -> DataFrame:
    """Coarser bars from finer bars."""
    keys = as_list(key)
    return (
        df.groupBy(*keys, floor_ts("ts", width_us).alias("__b"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_bars"),
        )
        .select(*keys, F.col("__b").alias("ts"), "open", "high", "low", "close", "volume", "n_bars",
                shift("__b", width_us).alias("available_at"))
    )


def anchored_start(ts: str, hours: int, tz: str, anchor_hour: int) -> tuple[Column, Column, Column]:
    """(UTC start, UTC end, unresolvable flag) of the local bin cut from ``anchor_hour`` local time.

    The flag marks bins whose local start happens twice or never on a
    clock-change night.
    """
    local = F.from_utc_timestamp(F.col(ts), tz)
    start_local = floor_ts(local, hours * HOUR_US, (anchor_hour % hours) * HOUR_US)
    start = F.to_utc_timestamp(start_local, tz)
    end = F.to_utc_timestamp(shift(start_local, hours * HOUR_US), tz)
    back = F.from_utc_timestamp(start, tz)
    again = F.from_utc_timestamp(shift(start, HOUR_US), tz)
    before = F.from_utc_timestamp(shift(start, -HOUR_US), tz)
    return start, end, (back != start_local) | (again == start_local) | (before == start_local)


def resample_anchored(
    df: DataFrame,
    key: str | Sequence[str],
    hours: int,
    tz: str,
    anchor_hour: int,
    order: Sequence[str] = ("ts", "tie"),
    price: str = "price",
    volume: str | None = "volume",
    drop_ambiguous: bool = True,
) -> DataFrame:
    """Bars on a local-time grid (for example New York 17:00) across clock changes."""
    keys = as_list(key)
    start, end, odd = anchored_start(order[0], hours, tz, anchor_hour)
    rows = df.filter(~odd) if drop_ambiguous else df
    return (
        rows.groupBy(*keys, start.alias("__b"))
        .agg(*ohlcv(order, price, volume), F.max(end).alias("__end"))
        .select(*keys, F.col("__b").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks",
                F.col("__end").alias("available_at"))
    )


def drop_partial(bars: DataFrame, ticks: DataFrame, key: str | Sequence[str], tick_ts: str = "ts") -> DataFrame:
    """Drop a trailing bar whose close is not covered by the data of its key."""
    keys = as_list(key)
    last = ticks.groupBy(*keys).agg(F.max(tick_ts).alias("__last"))
    return bars.join(last, keys).filter(F.col("available_at") <= F.col("__last")).drop("__last")


def volume_bars(
    df: DataFrame,
    key: str | Sequence[str],
    threshold: float,
    order: Sequence[str] = ("ts", "tie"),
    price: str = "price",
    volume: str = "volume",
) -> DataFrame:
    """New bar each time cumulative volume passes a multiple of ``threshold``."""
    keys = as_list(key)
    run = Series(df, keys, order).running({"__cum": ("sum", F.col(volume).cast("double"))})
    bar = F.floor((F.col("__cum") - F.col(volume)) / F.lit(float(threshold)))
    return _event_bars(run.withColumn("bar_id", bar), keys, order, price, volume)


def tick_count_bars(
    df: DataFrame,
    key: str | Sequence[str],
    n: int,
    order: Sequence[str] = ("ts", "tie"),
    price: str = "price",
    volume: str | None = "volume",
) -> DataFrame:
    """A bar every ``n`` ticks."""
    keys = as_list(key)
    run = Series(df, keys, order).numbered("__rn")
    return _event_bars(run.withColumn("bar_id", F.floor((F.col("__rn") - 1) / n)), keys, order, price, volume)


def _event_bars(df, keys, order, price, volume):
    return (
        df.groupBy(*keys, "bar_id")
        .agg(*ohlcv(order, price, volume), F.min(order[0]).alias("ts"), F.max(order[0]).alias("available_at"))
        .select(*keys, "bar_id", "ts", "open", "high", "low", "close", "volume", "n_ticks", "available_at")
    )


def common_grid(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Rows at timestamps where every series is present."""
    n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("__keys"))
    full = (
        df.select(key, ts).distinct()
        .groupBy(ts).agg(F.count(F.lit(1)).alias("__k"))
        .join(F.broadcast(n))  # one row
        .filter(F.col("__k") == F.col("__keys"))
        .select(ts)
    )
    return df.join(full, ts, "left_semi")


def coverage(df: DataFrame, key: str | Sequence[str], width_us: int, ts: str = "ts", floor: float = 0.95) -> DataFrame:
    """Rows over expected slots in each key's span, flagged when below ``floor``."""
    keys = as_list(key)
    slots = df.select(*keys, F.floor(F.unix_micros(ts) / width_us).alias("__s")).distinct()
    return slots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_slots"), (F.max("__s") - F.min("__s") + 1).alias("expected")
    ).select(*keys, "n_slots", "expected", (F.col("n_slots") / F.col("expected")).alias("share"),
             (F.col("n_slots") / F.col("expected") < floor).alias("flagged"))


def missing_slots(df: DataFrame, key: str | Sequence[str], width_us: int, ts: str = "ts") -> DataFrame:
    """Slots absent between the first and last slot of each key.

    The gap before each present slot is generated from ``lag``, so the calendar
    of a hot key is never built in one row.
    """
    keys = as_list(key)
    slots = df.select(*keys, floor_ts(ts, width_us).alias("slot")).distinct()
    with_prev = Series(slots, keys, ["slot"]).columns(
        lambda fr: {"__prev": F.lag("slot").over(fr.w())}, back_rows=1
    )
    step = width_us
    return (
        with_prev.filter(F.unix_micros("slot") - F.unix_micros("__prev") > step)
        .select(*keys, F.explode(F.sequence(F.unix_micros("__prev") + step, F.unix_micros("slot") - step, F.lit(step))).alias("__us"))
        .select(*keys, F.timestamp_micros("__us").alias("slot"))
    )


def project_completed(fine: DataFrame, coarse: DataFrame, key: str | Sequence[str], cols: Sequence[str], prefix: str) -> DataFrame:
    """Coarse values on fine rows, visible only once the coarse bar has closed."""
    keys = as_list(key)
    right = coarse.select(*keys, "available_at", *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return asof(fine, right, keys, left_ts="ts", right_ts="available_at", left_order=["ts"])


def prev_period_levels(df: DataFrame, key: str | Sequence[str], width_us: int = DAY_US) -> DataFrame:
    """High, low and close of the previous period present in the data, on each row."""
    keys = as_list(key)
    daily = (
        df.groupBy(*keys, floor_ts("ts", width_us).alias("period"))
        .agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"))
    )
    lagged = Series(daily, keys, ["period"]).columns(
        lambda fr: {f"prev_{n}": F.lag(n).over(fr.w()) for n in ("h", "l", "c")}, back_rows=1
    ).select(*keys, "period", F.col("prev_h").alias("prev_high"), F.col("prev_l").alias("prev_low"),
             F.col("prev_c").alias("prev_close"))
    return df.withColumn("period", floor_ts("ts", width_us)).join(lagged, [*keys, "period"])


def session_range(df: DataFrame, key: str | Sequence[str], start_hour: int = 0, end_hour: int = 7) -> DataFrame:
    """High/low/mid of an intraday session, published at its end."""
    keys = as_list(key)
    return (
        df.filter((F.hour("ts") >= start_hour) & (F.hour("ts") < end_hour))
        .groupBy(*keys, F.date_trunc("day", "ts").alias("day"))
        .agg(F.max("high").alias("session_high"), F.min("low").alias("session_low"))
        .select(*keys, "day", "session_high", "session_low",
                ((F.col("session_high") + F.col("session_low")) / 2).alias("session_mid"),
                shift("day", end_hour * HOUR_US).alias("available_at"))
    )


def calendar_gaps(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Last bar of a week (to Friday) against the first bar after the weekend."""
    keys = as_list(key)
    week = F.date_trunc("week", "ts")
    weekly = (
        df.withColumn("week", F.when(F.weekday("ts") == 6, shift(week, 7 * DAY_US)).otherwise(week))
        .filter(F.weekday("ts") != 5)
        .groupBy(*keys, "week")
        .agg(F.min_by("open", "ts").alias("week_open"),
             F.max_by(F.when(F.weekday("ts") < 5, F.col("close")), F.when(F.weekday("ts") < 5, F.col("ts"))).alias("week_close"))
    )
    return Series(weekly, keys, ["week"]).columns(
        lambda fr: {"prev_close": F.lag("week_close").over(fr.w())}, back_rows=1
    ).filter(F.col("prev_close").isNotNull()).select(
        *keys, "week", "prev_close", "week_open", (F.col("week_open") - F.col("prev_close")).alias("gap"))


def local_time_events(dates: DataFrame, tz: str, hour: int, date_col: str = "date") -> DataFrame:
    """Daily UTC instant of a local clock time, with a last-business-day flag."""
    from barline.functions.clock import last_business_day

    return dates.withColumn("instant", local_instant(date_col, tz, hour)).withColumn(
        "is_month_end", F.to_date(date_col) == last_business_day(date_col)
    )


def rebalance_dates(df: DataFrame, unit: str = "month", ts: str = "ts") -> DataFrame:
    """Last timestamp of each month and the next timestamp present after it."""
    cal = df.select(ts).distinct()
    nxt = Series(cal, None, [ts]).columns(lambda fr: {"execute_at": F.lead(ts).over(fr.w())}, fwd_rows=1)
    return (
        nxt.groupBy(F.date_trunc(unit, F.col(ts)).alias("period"))
        .agg(F.max(ts).alias("decide_at"), F.max_by("execute_at", ts).alias("execute_at"))
        .filter(F.col("execute_at").isNotNull())
    )


def best_offset(a: DataFrame, b: DataFrame, width_us: int, offsets: Sequence[int], price: str = "close") -> DataFrame:
    """Clock shift (in buckets) that maximises the correlation of returns of two feeds.

    Both inputs hold one row per bucket (``ts``, price); the candidate offsets
    are a literal array exploded on one side, then an equi-join.
    """
    def returns(df: DataFrame, name: str) -> DataFrame:
        return Series(df, None, ["ts"]).columns(
            lambda fr: {name: F.col(price) - F.lag(price).over(fr.w())}, back_rows=1
        ).select(F.floor(F.unix_micros("ts") / width_us).alias("__s"), name).filter(F.col(name).isNotNull())

    ra = returns(a, "__ra")
    rb = returns(b, "__rb").withColumn(
        "offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets]))
    ).withColumn("__s", F.col("__s") + F.col("offset"))
    return ra.join(rb, "__s").groupBy("offset").agg(
        F.corr("__ra", "__rb").alias("corr"), F.count(F.lit(1)).alias("n")
    )


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One deterministic row per key by min over the order columns (map-side combine)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__r")
    ).select(*keys, "__r.*")


def anchors(df: DataFrame, key: str | Sequence[str], unit: str, order: Sequence[str]) -> DataFrame:
    """First row of each minute/hour/day per key."""
    keys = as_list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys, F.date_trunc(unit, F.col(order[0])).alias("__u")).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__r")
    ).select(*keys, "__r.*")


def every_kth(df: DataFrame, key: str | Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    return Series(df, key, order).numbered("__rn").filter((F.col("__rn") - 1) % k == 0).drop("__rn")


def segments(df: DataFrame, key: str | Sequence[str], order: Sequence[str], max_gap_us: int) -> DataFrame:
    """Segment number per key; a step longer than ``max_gap_us`` starts a new one."""
    s = Series(df, key, order)
    gap = F.unix_micros(order[0]) - F.unix_micros("__prev")
    flagged = s.columns(lambda fr: {"__prev": F.lag(order[0]).over(fr.w())}, back_rows=1)
    return s.with_df(flagged.withColumn("__new", (F.coalesce(gap, F.lit(0)) > max_gap_us).cast("int"))).running(
        {"segment": ("sum", F.col("__new"))}
    ).drop("__prev", "__new")

