"""Interval joins by time bucket: equi-join on (key, bucket), then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.plans.series import as_list


def micros(col: Column | str) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def bucket_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(float(width_us))).cast("long")


def point_in_interval(
    intervals: DataFrame,
    points: DataFrame,
    key: str | list[str] | None,
    start: Column,
    end: Column,
    point: Column,
    width_us: int,
    include_start: bool = True,
    include_end: bool = True,
) -> DataFrame:
    """Join each interval row with the points inside it.

    ``start``/``end``/``point`` are microsecond columns.  Intervals are exploded
    into the buckets they touch, so every candidate pair is tested exactly once
    (a point lies in one bucket); a hot (key, bucket) is left to the
    adaptive skew join.
    """
    keys = as_list(key)
    left = intervals.withColumn("__s", start).withColumn("__e", end)
    left = left.filter(F.col("__s") <= F.col("__e")).withColumn(
        "__bk", F.explode(F.sequence(bucket_of(F.col("__s"), width_us), bucket_of(F.col("__e"), width_us)))
    )
    right = points.withColumn("__p", point).withColumn("__bk", bucket_of(F.col("__p"), width_us))
    lo = F.col("__p") >= F.col("__s") if include_start else F.col("__p") > F.col("__s")
    hi = F.col("__p") <= F.col("__e") if include_end else F.col("__p") < F.col("__e")
    return left.join(right, [*keys, "__bk"]).filter(lo & hi).drop("__bk", "__s", "__e", "__p")


def interval_overlap(
    a: DataFrame,
    b: DataFrame,
    key: str | list[str] | None,
    a_bounds: tuple[Column, Column],
    b_bounds: tuple[Column, Column],
    width_us: int,
) -> DataFrame:
    """Pairs of overlapping closed intervals, each pair once.

    Both sides are exploded into buckets; a pair is kept only in the bucket
    that holds the later of the two starts.
    """
    keys = as_list(key)
    left = a.withColumn("__as", a_bounds[0]).withColumn("__ae", a_bounds[1]).withColumn(
        "__bk", F.explode(F.sequence(bucket_of(a_bounds[0], width_us), bucket_of(a_bounds[1], width_us)))
    )
    right = b.withColumn("__bs", b_bounds[0]).withColumn("__be", b_bounds[1]).withColumn(
        "__bk", F.explode(F.sequence(bucket_of(b_bounds[0], width_us), bucket_of(b_bounds[1], width_us)))
    )
    hit = (F.col("__as") <= F.col("__be")) & (F.col("__ae") >= F.col("__bs"))
    first = bucket_of(F.greatest("__as", "__bs"), width_us) == F.col("__bk")
    return left.join(right, [*keys, "__bk"]).filter(hit & first).drop("__bk", "__as", "__ae", "__bs", "__be")
