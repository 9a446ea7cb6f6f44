"""Affine recurrence ``y[t] = a[t] * y[t-1] + b[t]`` as window expressions.

Rows are grouped into chunks.  Inside a chunk the recurrence is a scaled running
sum; what enters from outside is the end value of the previous chunk.  With a
constant ``a`` chunks have a fixed length shared by all scans of a stage, so any
number of scans needs one sort; older chunk ends are reached by fixed lags until
their weight is below double precision.  With a varying ``a`` a chunk ends when
the product of the ``a`` falls below e**-300 and only the previous chunk counts.
No Python runs and no key has to be walked row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.plans.matrixscan import block_starts, with_starts
from barline.plans.series import Frame, Series

# -ln of the weight at which a past row no longer changes a double
DECAY_EXPONENT = 40.0
CHUNK_EXPONENT = 300.0
RESET_EXPONENT = 700.0
CHUNK_ROWS = 512
OVERFLOW_EXPONENT = 600.0


def lookback(a: float) -> int:
    """Rows after which a constant decay ``a`` has forgotten its start."""
    return 1 if a <= 0 else int(math.ceil(DECAY_EXPONENT / -math.log(a)))


def affine(d: DataFrame, fr: Frame, out: str, a: float | Column, b: Column) -> DataFrame:
    """Add ``out`` with y=0 before the first row; null ``b`` counts as 0.

    ``a`` is a number in [0, 1) or a column in [0, 1].
    """
    if isinstance(a, (int, float)):
        return _affine_constant(d, fr, out, float(a), b)
    return _affine_varying(d, fr, out, a, b)


def _with_chunks(d: DataFrame, fr: Frame) -> DataFrame:
    """Number rows once per stage; all scans and later windows share this order."""
    if fr.chunk is None:
        d = d.withColumn("__crn", F.row_number().over(fr.w()) - 1)
        d = d.select("*", F.floor(F.col("__crn") / CHUNK_ROWS).alias("__chunk"), (F.col("__crn") % CHUNK_ROWS).cast("double").alias("__cj"))
        fr.chunk = "__chunk"
    return d


def _affine_constant(d: DataFrame, fr: Frame, out: str, a: float, b: Column) -> DataFrame:
    value = F.coalesce(b.cast("double"), F.lit(0.0))
    if a <= 0.0:
        return d.withColumn(out, value)
    c = -math.log(a)
    if c * CHUNK_ROWS > OVERFLOW_EXPONENT:
        return _affine_varying(d, fr, out, F.lit(a), b)
    d = _with_chunks(d, fr)
    z, loc, end = (f"__{out}_{s}" for s in ("z", "loc", "end"))
    j = F.col("__cj")
    d = d.withColumn(z, value * F.exp(j * F.lit(c)))
    inner = Frame([*fr.parts, "__chunk"], fr.order, fr.ts)
    d = d.withColumn(loc, F.exp(-j * F.lit(c)) * F.sum(z).over(inner.rows(Window.unboundedPreceding, 0)))
    if fr.max_rows is not None and fr.max_rows <= CHUNK_ROWS:
        return d.withColumn(out, F.col(loc)).drop(z, loc)
    # chunk ends lie CHUNK_ROWS apart, so older chunks are reached by fixed lags
    # until their weight is below double precision
    total = F.col(loc)
    for m in range(1, int(math.ceil(DECAY_EXPONENT / (c * CHUNK_ROWS)))):
        older = F.coalesce(F.lag(loc, m * CHUNK_ROWS).over(fr.w()), F.lit(0.0))
        total = total + F.lit(math.exp(-c * CHUNK_ROWS * m)) * older
    d = d.withColumn(end, F.when(j == CHUNK_ROWS - 1, total))
    carry = F.last(end, ignorenulls=True).over(fr.rows(Window.unboundedPreceding, -1))
    y = F.col(loc) + F.exp(-(j + 1) * F.lit(c)) * F.coalesce(carry, F.lit(0.0))
    return d.withColumn(out, y).drop(z, loc, end)


def _affine_varying(d: DataFrame, fr: Frame, out: str, a: Column, b: Column) -> DataFrame:
    s, chunk, base, loc, rn = (f"__{out}_{x}" for x in ("s", "ch", "base", "loc", "av"))
    value = F.coalesce(b.cast("double"), F.lit(0.0))
    d = d.withColumn(rn, a.cast("double"))
    step = F.when(F.col(rn) > 0, -F.log(F.col(rn))).otherwise(F.lit(RESET_EXPONENT))
    d = d.withColumn(s, F.sum(step).over(fr.rows(Window.unboundedPreceding, 0)))
    d = d.withColumn(chunk, F.floor(F.col(s) / F.lit(CHUNK_EXPONENT)))
    inner = Frame([*fr.parts, chunk], fr.order, fr.ts)
    d = d.withColumn(base, F.first(s).over(inner.rows(Window.unboundedPreceding, 0)))
    rel = F.col(s) - F.col(base)
    d = d.withColumn(
        loc,
        F.exp(-rel) * F.sum(value * F.exp(rel)).over(inner.rows(Window.unboundedPreceding, 0)),
    )
    last_of_chunk = F.col(chunk) != F.coalesce(F.lead(chunk).over(fr.w()), F.col(chunk) - 1)
    d = d.withColumn(f"{loc}e", F.when(last_of_chunk, F.struct(loc, s)))
    carry = F.last(f"{loc}e", ignorenulls=True).over(fr.rows(Window.unboundedPreceding, -1))
    d = d.withColumn(f"{loc}c", carry)
    y = F.col(loc) + F.coalesce(
        F.exp(F.col(f"{loc}c.{s}") - F.col(s)) * F.col(f"{loc}c.{loc}"), F.lit(0.0)
    )
    return d.withColumn(out, y).drop(rn, s, chunk, base, loc, f"{loc}e", f"{loc}c")


def affine_scan(series: Series, out: str, a: Column, b: Column, init: float = 0.0) -> DataFrame:
    """Public scan for any ``a`` in [0, 1], exact also where ``a`` stays at 1.

    A split key needs a carry: each block is folded to (A, B) with
    ``end = A * start + B``; a tree over these maps gives the start value of each
    block, which is joined back.
    """
    df, fr = series.blocks()
    d = df.withColumn("__a", a.cast("double")).withColumn("__b", b.cast("double"))
    d = affine(d, fr, "__y", F.col("__a"), F.col("__b"))
    step = F.when(F.col("__a") > 0, -F.log("__a")).otherwise(F.lit(RESET_EXPONENT))
    d = d.withColumn("__w", F.exp(-F.sum(step).over(fr.rows(Window.unboundedPreceding, 0))))
    if not series.is_split():
        return d.select(*series.df.columns, (F.col("__y") + F.col("__w") * F.lit(init)).alias(out))
    own = d.filter("__own")
    pos = F.struct(*[F.col(c) for c in series.order])
    folds = own.groupBy(*[F.col(p) for p in fr.parts]).agg(
        F.max_by("__w", pos).alias("__A"), F.max_by("__y", pos).alias("__B")
    )
    maps = folds.select(*series.key, "__blk", F.array("__A").alias("__A"), F.array("__B").alias("__b"))
    rows = with_starts(own, block_starts(maps, series.key, [init]), series.key)
    return rows.select(*series.df.columns, (F.col("__y") + F.col("__w") * F.col("__x0")[0]).alias(out))


def ema_seeded(d: DataFrame, fr: Frame, out: str, x: Column, n: int, alpha: float | None = None) -> DataFrame:
    """Exponential mean seeded with the simple mean of the first ``n`` values of ``x``."""
    k = 2.0 / (n + 1) if alpha is None else alpha
    v, cnt, b = f"__{out}_x", f"__{out}_c", f"__{out}_b"
    d = d.withColumn(v, x)
    d = d.withColumn(cnt, F.count(v).over(fr.rows(Window.unboundedPreceding, 0)))
    seed = F.avg(v).over(fr.last_n(n))
    d = d.withColumn(
        b,
        F.when(F.col(cnt) < n, F.lit(0.0))
        .when((F.col(cnt) == n) & F.col(v).isNotNull(), seed)
        .otherwise(F.lit(k) * F.col(v)),
    )
    d = affine(d, fr, out, 1.0 - k, F.col(b))
    return d.withColumn(out, F.when(F.col(cnt) >= n, F.col(out))).drop(v, cnt, b)


def wilder(d: DataFrame, fr: Frame, out: str, x: Column, n: int) -> DataFrame:
    """Wilder smoothing: mean seed, then (y*(n-1)+x)/n."""
    return ema_seeded(d, fr, out, x, n, 1.0 / n)


def ema_first(d: DataFrame, fr: Frame, out: str, x: Column, alpha: float) -> DataFrame:
    """Exponential mean seeded on the first non-null value of ``x``."""
    v, cnt = f"__{out}_x", f"__{out}_c"
    d = d.withColumn(v, x)
    d = d.withColumn(cnt, F.count(v).over(fr.rows(Window.unboundedPreceding, 0)))
    b = F.when((F.col(cnt) == 1) & F.col(v).isNotNull(), F.col(v)).otherwise(F.lit(alpha) * F.col(v))
    d = affine(d, fr, out, 1.0 - alpha, b)
    return d.withColumn(out, F.when(F.col(cnt) >= 1, F.col(out))).drop(v, cnt)


def emas(d: DataFrame, fr: Frame, specs: dict[str, tuple[Column, float, int | None]]) -> DataFrame:
    """Several exponential means of one stage: ``specs`` maps a name to (input, weight, rows of
    the mean seed; None seeds on the first value). The steps of all are taken together, so
    the number of plan nodes does not follow the number of means."""
    usual = {o: s for o, s in specs.items() if s[1] < 1 and -math.log(1.0 - s[1]) * CHUNK_ROWS <= OVERFLOW_EXPONENT}
    for out, (x, alpha, seed) in specs.items():
        if out not in usual:
            d = ema_first(d, fr, out, x, alpha) if seed is None else ema_seeded(d, fr, out, x, seed, alpha)
    if not usual:
        return d
    name = lambda out, what: f"__{out}_{what}"
    col = lambda out, what: F.col(name(out, what))

    def step(d: DataFrame, what: str, make) -> DataFrame:
        return d.withColumns({name(o, what): make(o, *usual[o]) for o in usual})

    def input_of(o, x, alpha, seed):
        first = (col(o, "c") == (1 if seed is None else seed)) & col(o, "x").isNotNull()
        value = F.when(first, col(o, "x") if seed is None else col(o, "seed")).otherwise(F.lit(alpha) * col(o, "x"))
        return F.coalesce(value if seed is None else F.when(col(o, "c") >= seed, value), F.lit(0.0)).cast("double")

    rate = {o: -math.log(1.0 - s[1]) for o, s in usual.items()}
    upto = fr.rows(Window.unboundedPreceding, 0)
    d = step(d, "x", lambda o, x, *_: x)
    d = step(d, "c", lambda o, *_: F.count(name(o, "x")).over(upto))
    seeded = {name(o, "seed"): F.avg(name(o, "x")).over(fr.last_n(s[2])) for o, s in usual.items() if s[2] is not None}
    d = d.withColumns(seeded) if seeded else d
    d = _with_chunks(d, fr)
    j = F.col("__cj")
    inner = Frame([*fr.parts, "__chunk"], fr.order, fr.ts).rows(Window.unboundedPreceding, 0)
    d = step(d, "z", lambda o, *s: input_of(o, *s) * F.exp(j * F.lit(rate[o])))
    d = step(d, "loc", lambda o, *_: F.exp(-j * F.lit(rate[o])) * F.sum(name(o, "z")).over(inner))
    value = {o: col(o, "loc") for o in usual}
    if fr.max_rows is None or fr.max_rows > CHUNK_ROWS:

        def whole(o):
            total = col(o, "loc")
            for m in range(1, int(math.ceil(DECAY_EXPONENT / (rate[o] * CHUNK_ROWS)))):
                older = F.coalesce(F.lag(name(o, "loc"), m * CHUNK_ROWS).over(fr.w()), F.lit(0.0))
                total = total + F.lit(math.exp(-rate[o] * CHUNK_ROWS * m)) * older
            return F.when(j == CHUNK_ROWS - 1, total)

        d = step(d, "end", lambda o, *_: whole(o))
        before = fr.rows(Window.unboundedPreceding, -1)
        d = step(d, "carry", lambda o, *_: F.last(name(o, "end"), ignorenulls=True).over(before))
        value = {o: col(o, "loc") + F.exp(-(j + 1) * F.lit(rate[o])) * F.coalesce(col(o, "carry"), F.lit(0.0)) for o in usual}
    d = d.withColumns({o: F.when(col(o, "c") >= (usual[o][2] or 1), value[o]) for o in usual})
    return d.drop(*[name(o, w) for o in usual for w in ("x", "c", "seed", "z", "loc", "end", "carry")])


def ema_rows(n: int, alpha: float | None = None) -> int:
    """Halo rows that make an EMA of a block equal to that of the whole key."""
    k = 2.0 / (n + 1) if alpha is None else alpha
    return n + lookback(1.0 - k)
