"""Ordered series that survive a hot key.

``Window.partitionBy(key)`` puts a whole key into one task.  When one key may
hold a third of a 100 TB table that task never ends, so every ordered operator
of this package goes through :class:`Series`:

* a cheap pre-aggregated count tells whether any key exceeds ``block_rows``;
* if none does (the usual case) the plan is the plain window plan;
* otherwise a table that is more than a scan is written once, as the layout and the blocks read
  it several times, and hot keys are cut into blocks of about ``block_rows`` consecutive
  rows.  Bounded frames receive *halo* rows from neighbouring blocks, and
  unbounded frames (running sums, last value, row numbers) are computed per
  block and completed with a carry taken from one row per block.

Cuts follow the order column, so equal positions stay in one block unless a
second order column has to be used to cut an over-full instant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS_CONF = "spark.barline.blockRows"
BROADCAST_ROWS_CONF = "spark.barline.broadcastRows"
MEASURE_BYTES_CONF = "spark.barline.measureBytes"
DEFAULT_BLOCK_ROWS = 1_000_000
DEFAULT_BROADCAST_ROWS = 500_000
DEFAULT_MEASURE_BYTES = 64 << 20
#: Rows that a task sorts: a measured table of more is dealt over more tasks than the session's.
TASK_ROWS_CONF = "spark.barline.taskRows"
DEFAULT_TASK_ROWS = 1_000_000

CHUNK_COLUMNS = ("__crn", "__chunk", "__cj")
_BLK = "__blk"
_OWN = "__own"


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def position(df: DataFrame, name: str) -> Column:
    """Numeric position of an order column (microseconds for time columns)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double")


def input_bytes(df: DataFrame) -> int:
    """Size of the files and relations a plan reads, as known to Catalyst without running it.

    Below the threshold even one task holding everything is cheap, so the
    counting pass is not worth its job.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def reads_files_alone(df: DataFrame) -> bool:
    """Whether a table is a scan with filters and columns, which is cheap to read again."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation", "View"):
            if node.children().size():
                return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


@dataclass
class Frame:
    """Window specs inside one block (or one key when nothing is split)."""

    parts: list[str]
    order: list[str]
    ts: str
    max_rows: int | None = None
    # a column that never decreases along the order; once set, windows sort by it
    # first, so windows over (parts, chunk) and over parts share one sort
    chunk: str | None = None

    def w(self) -> WindowSpec:
        parts = [F.col(c) for c in self.parts] or [F.lit(0)]
        lead = [self.chunk] if self.chunk else []
        return Window.partitionBy(*parts).orderBy(*[F.col(c) for c in (*lead, *self.order)])

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.w().rowsBetween(start, end)

    def last_n(self, n: int) -> WindowSpec:
        return self.rows(-(n - 1), 0)

    def range_us(self, start: int, end: int) -> WindowSpec:
        parts = [F.col(c) for c in self.parts] or [F.lit(0)]
        return (
            Window.partitionBy(*parts)
            .orderBy(F.unix_micros(F.col(self.ts)))
            .rangeBetween(start, end)
        )


@dataclass
class _Layout:
    table: DataFrame
    small: bool
    widths: list[float]
    max_bucket: int


@dataclass
class Series:
    """A table seen as ``key``-wise ordered series.

    ``bounded_rows`` states a proven bound on rows per key (for example bars on
    a calendar grid); when it is below the block size the counting pass is
    skipped.
    """

    df: DataFrame
    key: str | Sequence[str] | None
    order: str | Sequence[str]
    bounded_rows: int | None = None
    block_rows: int | None = None
    _layout: _Layout | None = field(default=None, repr=False)
    _checked: bool = field(default=False, repr=False)

    def __post_init__(self) -> None:
        self.key = as_list(self.key)
        self.order = as_list(self.order)
        conf = self.df.sparkSession.conf
        if self.block_rows is None:
            self.block_rows = int(conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))
        self.max_rows = self.bounded_rows
        self.n_rows = None

    # ----- layout ---------------------------------------------------------

    def with_df(self, df: DataFrame) -> Series:
        """Same rows, more columns: keep the layout already measured."""
        s = Series(df, self.key, self.order, self.bounded_rows, self.block_rows)
        s._layout, s._checked, s.max_rows, s.n_rows = self._layout, self._checked, self.max_rows, self.n_rows
        return s

    def _key_cols(self) -> list[Column]:
        return [F.col(c) for c in self.key]

    def is_split(self) -> bool:
        if not self._checked:
            self._checked = True
            unbounded = self.bounded_rows is None or self.bounded_rows > self.block_rows
            conf = self.df.sparkSession.conf
            worth = int(conf.get(MEASURE_BYTES_CONF, str(DEFAULT_MEASURE_BYTES)))
            if unbounded and input_bytes(self.df) >= worth:
                self._measure()
        return self._layout is not None

    def crowded(self) -> bool:
        """Whether some place of the order holds more rows than a block and cannot be cut."""
        return self.is_split() and self._layout.max_bucket > self.block_rows

    def spread(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """Rows dealt by ``cols`` over enough tasks that what one sorts does not grow with the
        table. Tables that were not measured, or fit the session's shuffle, stay as they are."""
        conf = self.df.sparkSession.conf
        tasks = -(-(self.n_rows or 0) // int(conf.get(TASK_ROWS_CONF, str(DEFAULT_TASK_ROWS))))
        return df.repartition(tasks, *[F.col(c) for c in cols]) if cols and tasks > int(conf.get("spark.sql.shuffle.partitions")) else df

    def _measure(self) -> None:
        from barline.sources.sinks import materialize  # that module needs this one

        if not reads_files_alone(self.df):
            self.df = materialize(self.df, "series")
        sizes = self.df.groupBy(*self._key_cols()).agg(F.count(F.lit(1)).alias("__n"))
        longest, total = sizes.agg(F.max("__n"), F.sum("__n")).collect()[0]
        self.max_rows, self.n_rows = longest or 0, total or 0
        if self.max_rows <= self.block_rows:
            return
        hot = sizes.filter(F.col("__n") > self.block_rows).drop("__n")
        df = self.df
        if self.key:
            cond = None
            hot = hot.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(self.key)])
            for i, k in enumerate(self.key):
                c = F.col(k).eqNullSafe(F.col(f"__h{i}"))
                cond = c if cond is None else cond & c
            df = df.join(hot, cond, "left_semi")
        widths = self._choose_widths(df)
        buckets = self._buckets(df, widths)
        counts = df.groupBy(*self._key_cols(), *buckets).agg(F.count(F.lit(1)).alias("__n"))
        counts = materialize(counts, "layout")
        fullest = counts.agg(F.max("__n"), F.count(F.lit(1))).collect()[0]
        limit = int(self.df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))
        w = Window.partitionBy(*(self._key_cols() or [F.lit(0)])).orderBy("__f0", "__f1")
        table = counts.withColumn(
            "__c0", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
        ).withColumn("__cut", F.floor(F.col("__c0") / F.lit(self.block_rows)))
        self._layout = _Layout(table, int(fullest[1]) <= limit, widths, int(fullest[0]))

    def _choose_widths(self, df: DataFrame) -> list[float]:
        pos = [position(df, c) for c in self.order[:2]]
        spans = df.agg(*[(F.max(p) - F.min(p)).alias(f"s{i}") for i, p in enumerate(pos)]).collect()[0]
        widths = [max(float(spans[0] or 0) / 4096.0, 1e-9), 0.0]
        for _ in range(6):
            full = (
                df.groupBy(*self._key_cols(), F.floor(pos[0] / F.lit(widths[0])).alias("__f"))
                .agg(F.count(F.lit(1)).alias("__n"))
                .agg(F.max("__n"))
                .collect()[0][0]
            )
            if full <= max(self.block_rows // 4, 1):
                return widths
            widths[0] = max(widths[0] / 64.0, 1e-9)
        if len(pos) > 1 and spans[1]:
            widths[1] = max(float(spans[1]) / 4096.0, 1e-9)
        return widths

    def _buckets(self, df: DataFrame, widths: list[float]) -> list[Column]:
        first = F.floor(position(df, self.order[0]) / F.lit(widths[0])).alias("__f0")
        second = (
            F.floor(position(df, self.order[1]) / F.lit(widths[1])) if widths[1] else F.lit(0).cast("long")
        ).alias("__f1")
        return [first, second]

    # ----- blocks ---------------------------------------------------------

    def blocks(
        self,
        back_rows: int = 0,
        fwd_rows: int = 0,
        back_us: int = 0,
        fwd_us: int = 0,
    ) -> tuple[DataFrame, Frame]:
        """Rows with block id and halo copies, plus the window specs to use on them."""
        if not self.is_split():
            return self.df, Frame(list(self.key), list(self.order), self.order[0], self.max_rows)
        lay = self._layout
        parts = self._key_cols() or [F.lit(0)]
        by_rows = Window.partitionBy(*parts).orderBy("__c0")
        by_pos = Window.partitionBy(*parts).orderBy("__f0")
        lo, hi = F.col("__cut"), F.col("__cut")
        if back_rows:
            hi = F.greatest(hi, F.max("__cut").over(by_rows.rangeBetween(0, back_rows + lay.max_bucket)))
        if fwd_rows:
            lo = F.least(lo, F.min("__cut").over(by_rows.rangeBetween(-(fwd_rows + lay.max_bucket), 0)))
        if back_us:
            hi = F.greatest(
                hi, F.max("__cut").over(by_pos.rangeBetween(0, int(back_us / lay.widths[0]) + 1))
            )
        if fwd_us:
            lo = F.least(
                lo, F.min("__cut").over(by_pos.rangeBetween(-(int(fwd_us / lay.widths[0]) + 1), 0))
            )
        table = lay.table.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)],
            F.col("__f0").alias("__g0"),
            F.col("__f1").alias("__g1"),
            F.col("__cut"),
            lo.alias("__lo"),
            hi.alias("__hi"),
        )
        if lay.small:
            table = F.broadcast(table)
        buckets = self._buckets(self.df, lay.widths)
        df = self.df.select("*", *buckets)
        cond = (F.col("__f0") == F.col("__g0")) & (F.col("__f1") == F.col("__g1"))
        for i, k in enumerate(self.key):
            cond = cond & (F.col(k) == F.col(f"__k{i}"))
        zero = F.lit(0).cast("long")
        out = (
            df.join(table, cond, "left")
            .withColumn(
                _BLK,
                F.explode(F.sequence(F.coalesce("__lo", zero), F.coalesce("__hi", zero))),
            )
            .withColumn(_OWN, F.col(_BLK) == F.coalesce("__cut", zero))
            .select(*self.df.columns, _BLK, _OWN)
        )
        return out, Frame([*self.key, _BLK], list(self.order), self.order[0], None)

    def map(
        self,
        fn: Callable[[DataFrame, Frame], DataFrame],
        back_rows: int = 0,
        fwd_rows: int = 0,
        back_us: int = 0,
        fwd_us: int = 0,
    ) -> DataFrame:
        """Apply a stage of bounded-frame windows; ``fn`` sees enough halo rows."""
        df, frame = self.blocks(back_rows, fwd_rows, back_us, fwd_us)
        out = fn(df, frame).drop(*CHUNK_COLUMNS)
        if self._layout is not None:
            out = out.filter(F.col(_OWN)).drop(_BLK, _OWN)
        return out

    def columns(self, fn: Callable[[Frame], dict[str, Column]], **halo: int) -> DataFrame:
        """Add window columns computed side by side in one select."""
        return self.map(lambda d, fr: d.select("*", *[c.alias(n) for n, c in fn(fr).items()]), **halo)

    # ----- running (unbounded) aggregates ---------------------------------

    def running(
        self,
        specs: dict[str, tuple[str, Column]],
        exclusive: bool = False,
        reverse: bool = False,
    ) -> DataFrame:
        """Running aggregates from the start (or, reversed, from the end) of each key.

        ``specs`` maps a column name to (kind, column); kinds are ``sum``,
        ``count``, ``min``, ``max``, ``last`` (last non-null seen) and ``first``.
        """
        aggs = {
            "sum": F.sum,
            "count": F.count,
            "min": F.min,
            "max": F.max,
            "last": lambda c: F.last(c, ignorenulls=True),
            "first": lambda c: F.first(c, ignorenulls=True),
        }
        df, fr = self.blocks()
        df = self.spread(df, fr.parts)
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in fr.order]
        parts = [F.col(c) for c in fr.parts] or [F.lit(0)]
        w = Window.partitionBy(*parts).orderBy(*order)
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        if self._layout is None:
            return df.select("*", *[aggs[k](c).over(frame).alias(n) for n, (k, c) in specs.items()])
        local = df.select(
            "*",
            *[c.alias(f"__v{i}") for i, (_, c) in enumerate(specs.values())],
            *[aggs[k](c).over(frame).alias(f"__l{i}") for i, (k, c) in enumerate(specs.values())],
        )
        pos = F.struct(*[F.col(c) for c in self.order])
        totals_by = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        first_is_max = reverse
        aggregates = []
        for i, (kind, c) in enumerate(specs.values()):
            if kind in totals_by:
                agg = totals_by[kind](c)
            else:
                newest = (kind == "last") != first_is_max
                pick = F.max_by if newest else F.min_by
                agg = pick(c, F.when(c.isNotNull(), pos))
            aggregates.append(agg.alias(f"__t{i}"))
        # own rows of hot keys only: a handful of rows per hot key
        own = df.filter(F.col(_OWN))
        totals = own.groupBy(*[F.col(p) for p in fr.parts]).agg(*aggregates)
        kcols = [F.col(k) for k in self.key] or [F.lit(0)]
        bw = Window.partitionBy(*kcols).orderBy(F.col(_BLK).desc() if reverse else F.col(_BLK).asc())
        before = bw.rowsBetween(Window.unboundedPreceding, -1)
        many = F.count(F.lit(1)).over(Window.partitionBy(*kcols)) > 1
        carry_aggs = dict(aggs, count=F.sum)
        carry = (
            totals.select(
                "*",
                many.alias("__many"),
                *[
                    carry_aggs[k](F.col(f"__t{i}")).over(before).alias(f"__p{i}")
                    for i, (k, _) in enumerate(specs.values())
                ],
            )
            .filter("__many")
            .select(
                *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)],
                F.col(_BLK).alias("__cb"),
                *[f"__p{i}" for i in range(len(specs))],
            )
        )
        if self._layout.small:
            carry = F.broadcast(carry)
        cond = F.col(_BLK) == F.col("__cb")
        for i, k in enumerate(self.key):
            cond = cond & (F.col(k) == F.col(f"__k{i}"))
        joined = local.filter(F.col(_OWN)).join(carry, cond, "left")
        out = []
        for i, (name, (kind, _)) in enumerate(specs.items()):
            here, prev = F.col(f"__l{i}"), F.col(f"__p{i}")
            if kind in ("sum", "count"):
                both = F.coalesce(prev + here, prev, here)
            elif kind == "min":
                both = F.least(prev, here)
            elif kind == "max":
                both = F.greatest(prev, here)
            elif kind == "last":
                both = F.coalesce(here, prev)
            else:
                both = F.coalesce(prev, here)
            if kind == "count":
                both = F.coalesce(both, F.lit(0).cast("long"))
            out.append(both.alias(name))
        return joined.select(*self.df.columns, *out)

    def numbered(self, name: str = "rn") -> DataFrame:
        """Row number per key, 1-based, without gathering a key in one task."""
        return self.running({name: ("count", F.lit(1))})
