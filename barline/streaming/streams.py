"""Streams of ticks: ingest, de-duplication, windows, joins, side output, retention.

State is bounded everywhere by a watermark.  Sinks that need exactly-once
semantics are written by ``foreachBatch`` keyed on the data's own keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators.bars import ohlcv
from barline.plans.series import as_list
from barline.sources.readers import with_utc_timestamps


def stream_ticks(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """File stream of ticks; a Kafka source plugs in at the same place."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_utc_timestamps(reader.load(path))


def stream_dedupe(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_bars(df: DataFrame, key: str | Sequence[str], grain: str, delay: str, order: Sequence[str] = ("ts", "tie"), price: str = "price", volume: str | None = "volume") -> DataFrame:
    """Clock-aligned bars, emitted once the watermark has passed their end."""
    keys = as_list(key)
    g = df.withWatermark(order[0], delay).groupBy(*keys, F.window(order[0], grain)).agg(*ohlcv(order, price, volume))
    return g.select(*keys, F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks", F.col("window.end").alias("available_at"))


def stream_sliding(df: DataFrame, key: str | Sequence[str], length: str, slide: str, delay: str, order: Sequence[str] = ("ts", "tie"), price: str = "price") -> DataFrame:
    keys = as_list(key)
    g = df.withWatermark(order[0], delay).groupBy(*keys, F.window(order[0], length, slide)).agg(
        *ohlcv(order, price, None), F.avg(price).alias("mean"), F.stddev_samp(price).alias("std"))
    return g.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "mean", "std", "n_ticks")


def stream_sessions(df: DataFrame, key: str | Sequence[str], gap: str, delay: str, ts: str = "ts", price: str = "price") -> DataFrame:
    keys = as_list(key)
    g = df.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available, then stop; restarts continue from the checkpoint."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(batch) if batch else w.format("parquet").option("path", path)).start()
    q.awaitTermination()


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A sink that may not have received a row yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def late_to_side(main: str, side: str, ts: str, delay_us: int) -> Callable[[DataFrame, int], None]:
    """Batch writer: rows older than the newest stored instant minus the delay go to a side table.

    The bound is read from the main table itself, so a restarted job decides alike.
    Each batch overwrites its own directory, so a replayed batch does not repeat rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bound = None
        try:
            earlier = spark.read.parquet(main).filter(F.col("batch") < batch_id)
            bound = earlier.agg(F.max(F.unix_micros(ts))).collect()[0][0]
        except AnalysisException:
            bound = None
        late = F.lit(False) if bound is None else F.unix_micros(ts) < F.lit(bound - delay_us)
        batch.filter(~late).write.mode("overwrite").parquet(f"{main}/batch={batch_id}")
        batch.filter(late).write.mode("overwrite").parquet(f"{side}/batch={batch_id}")

    return write


def enrich(stream: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Stream-static join: the static side is re-planned per batch, broadcast when its size allows."""
    return stream.join(dim, as_list(on), how)


def stream_match(signals: DataFrame, fills: DataFrame, key: str, horizon: str, delay: str, signal_ts: str = "signal_ts", fill_ts: str = "fill_ts") -> DataFrame:
    """Fills within a horizon after each signal; both sides are forgotten by watermark."""
    s = signals.withWatermark(signal_ts, delay)
    f = fills.withWatermark(fill_ts, delay).withColumnRenamed(key, f"fill_{key}")
    cond = (F.col(key) == F.col(f"fill_{key}")) & (F.col(fill_ts) >= F.col(signal_ts)) & (F.col(fill_ts) <= F.col(signal_ts) + F.expr(f"INTERVAL {horizon}"))
    return s.join(f, cond, "inner").drop(f"fill_{key}")


def stream_cross_section(df: DataFrame, key: str, every: str, delay: str, path: str, order: Sequence[str] = ("ts", "tie"), price: str = "price"):
    """Last price per key and window, ranked per window as each batch completes."""
    bars = stream_bars(df, key, every, delay, order, price, None)

    def write(batch: DataFrame, batch_id: int) -> None:
        from barline.operators.xsection import xs_rank

        ranked = xs_rank(batch.select(key, "ts", "close"), "ts", "close", key)
        ranked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return bars, write


def check_parity(stream_result: DataFrame, batch_result: DataFrame) -> DataFrame:
    """Rows present in only one of the two paths; empty when they agree."""
    cols = batch_result.columns
    a, b = stream_result.select(*cols), batch_result
    return a.exceptAll(b).withColumn("side", F.lit("stream")).unionAll(b.exceptAll(a).withColumn("side", F.lit("batch")))


def parity_counts(stream_result: DataFrame, batch_result: DataFrame) -> DataFrame:
    """One row: rows of either path and rows that only one of them has."""
    sides = stream_result.select(*batch_result.columns).withColumn("__s", F.lit(1)).unionAll(batch_result.withColumn("__s", F.lit(0)))
    by_row = sides.groupBy(*batch_result.columns).agg(F.sum("__s").alias("__a"), F.sum(1 - F.col("__s")).alias("__b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_row.agg(total(F.col("__a")).alias("n_stream"), total(F.col("__b")).alias("n_batch"), total(F.abs(F.col("__a") - F.col("__b"))).alias("n_apart"))


def complete_before(bars: DataFrame, watermark: Column) -> DataFrame:
    """Batch bars a stream would have emitted by the given watermark."""
    return bars.filter(F.col("available_at") <= watermark)


def expire(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Retention rule of stored history; state itself expires by watermark or TTL."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))
