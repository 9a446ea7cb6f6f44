"""As-of joins: union of both sides, then the last (or next) right row by a running scan.

One shuffle of both sides by key and one sort; a hot key is cut into blocks and
completed with one carried row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.clock import floor_ts
from barline.plans.series import Series, as_list, reads_files_alone
from barline.sources.sinks import materialize


def asof(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str] | None,
    left_ts: str = "ts",
    right_ts: str = "available_at",
    direction: str = "backward",
    strict: bool = False,
    tolerance_us: int | None = None,
    left_order: Sequence[str] = (),
    keep_right_ts: str | None = None,
    allow_open_stamp: bool = False,
    instants: bool = False,
) -> DataFrame:
    """Attach to each left row the latest right row known at its time.

    ``right_ts`` must be the instant the right row becomes known; joining on an
    opening stamp leaks the future, so a right side stamped ``ts`` is refused
    unless ``allow_open_stamp`` says the rows are instantaneous.
    Unmatched left rows keep null right columns.

    An instant that holds more rows than a block is looked up once and joined back to its
    left rows; ``instants`` says that both sides have one row per key and instant.
    """
    if right_ts == "ts" and not allow_open_stamp:
        raise ValueError("as-of join needs the right side's available_at, not its opening stamp")
    keys = as_list(key)
    payload = [c for c in right.columns if c not in keys and c != right_ts]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    # at equal instants: backward non-strict sees right first, strict sees left first;
    # forward is the mirror image
    right_first = (direction == "backward") != strict
    l_side, r_side = (1, 0) if right_first else (0, 1)
    rest = [c for c in left.columns if c not in keys]
    lrows = left.select(
        *keys,
        F.col(left_ts).alias("__t"),
        F.lit(l_side).alias("__side"),
        F.struct(*[F.col(c) for c in rest]).alias("__l"),
        F.lit(None).cast(right.select(F.struct(F.col(right_ts).alias("__rt"), *payload)).schema[0].dataType).alias("__r"),
    )
    rrows = right.filter(F.col(right_ts).isNotNull()).select(
        *keys,
        F.col(right_ts).alias("__t"),
        F.lit(r_side).alias("__side"),
        F.lit(None).cast(lrows.schema["__l"].dataType).alias("__l"),
        F.struct(F.col(right_ts).alias("__rt"), *[F.col(c) for c in payload]).alias("__r"),
    )
    both = Series(lrows.unionByName(rrows), keys, ["__t", "__side"])
    if not instants and both.crowded():
        return _asof_by_instant(left, right, keys, left_ts, right_ts, direction, strict, tolerance_us, keep_right_ts, payload)
    found = both.running({"__m": ("last", F.col("__r"))}, reverse=(direction == "forward"))
    out = found.filter(F.col("__l").isNotNull())
    if tolerance_us is not None:
        dist = F.abs(F.unix_micros("__t") - F.unix_micros("__m.__rt"))
        out = out.withColumn("__m", F.when(dist <= tolerance_us, F.col("__m")))
    cols = [F.col(f"__l.{c}").alias(c) for c in rest] + [F.col(f"__m.{c}").alias(c) for c in payload]
    if keep_right_ts:
        cols.append(F.col("__m.__rt").alias(keep_right_ts))
    return out.select(*keys, *cols)


#: Shares into which the left rows of an instant are dealt.
SALTS = 16


def _asof_by_instant(left, right, keys, left_ts, right_ts, direction, strict, tolerance_us, keep_right_ts, payload) -> DataFrame:
    """The join by instants: one right row per (key, instant), found from distinct left
    instants; left rows then fetch it by (key, instant), an instant's rows in ``SALTS`` shares."""
    row = F.struct(*[F.col(c) for c in payload])
    one = right.filter(F.col(right_ts).isNotNull()).groupBy(*keys, right_ts).agg(F.max_by(row, F.xxhash64(*payload)).alias("__row"))
    asked = left.select(*keys, F.col(left_ts).alias("__at")).distinct()
    kept = keep_right_ts or "__found_at"
    found = asof(asked, one, keys, "__at", right_ts, direction, strict, tolerance_us, keep_right_ts=kept, allow_open_stamp=True, instants=True)
    copies = found.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__at", "__row", F.col(kept).alias("__kept"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__share"))
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    cond = F.col(left_ts).eqNullSafe(F.col("__at")) & (F.col("__salt") == F.col("__share"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    cols = [F.col(f"__row.{c}").alias(c) for c in payload] + ([F.col("__kept").alias(keep_right_ts)] if keep_right_ts else [])
    return dealt.join(copies, cond, "left").select(*keys, *[c for c in left.columns if c not in keys], *cols)


def asof_instants(left: DataFrame, right: DataFrame, left_ts: str = "ts", right_ts: str = "available_at", **more) -> DataFrame:
    """The join without a key for a left table that repeats few instants, such as dates: they
    are looked up once and its rows fetch what was found, so rows are not sorted as one series.
    The right side has one row per instant."""
    if not reads_files_alone(left):
        left = materialize(left, "left")
    asked = left.select(left_ts).distinct()
    return left.join(asof(materialize(asked, "instants"), materialize(right, "known"), None, left_ts, right_ts, instants=True, **more), left_ts, "left")


def next_after(left: DataFrame, calendar: DataFrame, left_ts: str, cal_ts: str, out: str) -> DataFrame:
    """First calendar instant strictly after each left instant."""
    right = calendar.select(F.col(cal_ts).alias("__cal")).distinct()
    return asof_instants(left, right, left_ts, "__cal", direction="forward", strict=True, keep_right_ts=out)


def contain(fine: DataFrame, coarse: DataFrame, key: str | Sequence[str], width_us: int, coarse_id: str) -> DataFrame:
    """Fine row to the coarse bar that contains it; -1 when there is none."""
    keys = as_list(key)
    right = coarse.select(*keys, F.col("ts").alias("__b"), F.col(coarse_id).alias("coarse_id"))
    return (
        fine.withColumn("__b", floor_ts("ts", width_us))
        .join(right, [*keys, "__b"], "left")
        .withColumn("coarse_id", F.coalesce("coarse_id", F.lit(-1)))
        .drop("__b")
    )
