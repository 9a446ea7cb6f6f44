"""Joins: dimension, signed bridge, fallback look-up, paths, overlaps, grids, listed pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.plans.rangejoin import interval_overlap, micros, point_in_interval
from barline.plans.series import Series, as_list


def with_dim(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Metadata per row; Spark broadcasts the dimension when its size allows."""
    return df.join(dim, as_list(on))


def signed_explode(df: DataFrame, bridge: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Each instrument row to its entities with sign (bridge columns: key, entity, sign)."""
    return df.join(bridge, as_list(on))


def pair_bridge(dim: DataFrame, key: str, base: str, quote: str) -> DataFrame:
    """(key, entity, sign) rows: +1 for the base entity, -1 for the quote entity."""
    legs = F.array(
        F.struct(F.col(base).alias("entity"), F.lit(1).alias("sign")),
        F.struct(F.col(quote).alias("entity"), F.lit(-1).alias("sign")),
    )
    return dim.select(key, F.explode(legs).alias("__leg")).select(key, "__leg.entity", "__leg.sign")


def lookup_fallback(
    df: DataFrame,
    first: tuple[DataFrame, Sequence[str], str],
    second: tuple[DataFrame, Sequence[str], str],
    default: Column,
    out: str,
) -> DataFrame:
    """Exact look-up, else a coarser one, else a constant."""
    t1, k1, v1 = first
    t2, k2, v2 = second
    j = df.join(t1.select(*k1, F.col(v1).alias("__v1")), list(k1), "left")
    j = j.join(t2.select(*k2, F.col(v2).alias("__v2")), list(k2), "left")
    return j.withColumn(out, F.coalesce("__v1", "__v2", default)).drop("__v1", "__v2")


def pair_join(df: DataFrame, a: object, b: object, key: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """Two series side by side on common timestamps, from one grouped pass (no self-join)."""
    aggs = []
    for c in cols:
        aggs += [F.max(F.when(F.col(key) == a, F.col(c))).alias(f"{c}_a"), F.max(F.when(F.col(key) == b, F.col(c))).alias(f"{c}_b")]
    both = F.max((F.col(key) == a).cast("int")) + F.max((F.col(key) == b).cast("int"))
    return (
        df.filter(F.col(key).isin(a, b)).groupBy(ts).agg(both.alias("__n"), *aggs).filter("__n = 2").drop("__n")
    )


def panel(df: DataFrame, key: str, ts: str, value: str, keys: Sequence[object], prefix: str = "v_") -> DataFrame:
    """Wide panel of listed series on their common timestamps."""
    wide = df.groupBy(ts).pivot(key, list(keys)).agg(F.max(value))
    named = wide.select(ts, *[F.col(f"`{k}`").alias(f"{prefix}{k}") for k in keys])
    return named.dropna(subset=[f"{prefix}{k}" for k in keys])


def listed_pairs(df: DataFrame, pairs: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Rows (a, b, ts, va, vb) for listed pairs of entities at common timestamps.

    ``pairs`` has columns a, b.  Work grows with the listed pairs, never with
    all pairs inside a timestamp.
    """
    left = df.select(F.col(key).alias("a"), ts, F.col(value).alias("va"))
    right = df.select(F.col(key).alias("b"), ts, F.col(value).alias("vb"))
    return left.join(pairs, "a").join(right, ["b", ts])


def path(
    events: DataFrame,
    bars: DataFrame,
    key: str | Sequence[str] | None,
    horizon_us: int,
    event_ts: str = "event_ts",
    ts: str = "ts",
    include_start: bool = True,
) -> DataFrame:
    """All bars inside [entry, entry + horizon] of each event."""
    start = micros(event_ts)
    return point_in_interval(
        events, bars, key, start, start + horizon_us, micros(ts), max(horizon_us, 1), include_start=include_start
    )


def backward_path(events, bars, key, horizon_us: int, event_ts: str = "event_ts", ts: str = "ts") -> DataFrame:
    """All bars inside [entry - horizon, entry)."""
    end = micros(event_ts)
    return point_in_interval(events, bars, key, end - horizon_us, end, micros(ts), max(horizon_us, 1), include_end=False)


def overlaps(a: DataFrame, b: DataFrame, key, a_cols: tuple[str, str], b_cols: tuple[str, str], width_us: int) -> DataFrame:
    """Pairs of intervals of two books that overlap in time."""
    return interval_overlap(
        a, b, key, (micros(a_cols[0]), micros(a_cols[1])), (micros(b_cols[0]), micros(b_cols[1])), width_us
    )


def grid(df: DataFrame, params: Sequence[dict[str, float]]) -> DataFrame:
    """Every row against each parameter row: a literal array exploded in place, no join."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    cols = df.columns
    return df.withColumn("__p", F.explode(rows)).select(*cols, "__p.*")


def overlap_counts(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], a_ids: Sequence[str]) -> DataFrame:
    """How many intervals of ``b`` overlap each interval of ``a``, without building the pairs:
    those that start by its end less those that end before its start."""
    nothing = [F.lit(None).cast(a.schema[c].dataType).alias(c) for c in a_ids]

    def marks(df: DataFrame, at: str, rank: int, is_start: bool, asks: bool) -> DataFrame:
        one = lambda here: F.lit(int(here and not asks)).cast("long")
        return df.select(key, F.col(at).alias("__t"), F.lit(rank).alias("__rank"), one(is_start).alias("__s"), one(not is_start).alias("__e"), *(a_ids if asks else nothing))

    # at one instant: who asks for ends before it, what starts and ends, who asks for starts by it
    rows = marks(a, a_span[0], 0, True, True).unionByName(marks(b, b_span[0], 1, True, False))
    rows = rows.unionByName(marks(b, b_span[1], 2, False, False)).unionByName(marks(a, a_span[1], 3, False, True))
    # a key's marks in one order, so an unsplit key's results are added up where they are
    series = Series(rows, key, ["__t", "__rank"])
    run = series.running({"__starts": ("sum", F.col("__s")), "__ends": ("sum", F.col("__e"))})
    run = run.filter(F.col("__rank").isin(0, 3))
    run = series.spread(run, [key, *a_ids]) if series.is_split() else run
    signed = F.when(F.col("__rank") == 3, F.col("__starts")).otherwise(-F.col("__ends"))
    return run.groupBy(key, *a_ids).agg(F.sum(signed).alias("n"))
