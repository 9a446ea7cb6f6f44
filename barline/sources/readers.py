"""Parquet, CSV and JSON readers for bars, ticks, reports and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.plans.series import Series, as_list

TICK_JSON_SCHEMA = T.StructType(
    [
        T.StructField("ms", T.LongType()),
        T.StructField("p", T.StringType()),
        T.StructField("b", T.DoubleType()),
        T.StructField("a", T.DoubleType()),
    ]
)
TICK_CSV_SCHEMA = T.StructType(
    [
        T.StructField("stamp", T.StringType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
TICK_CSV_STAMP = "yyyyMMdd HHmmssSSS"


def with_utc_timestamps(df: DataFrame) -> DataFrame:
    """Read zone-less timestamps as UTC instants."""
    cols = [
        F.col(f.name).cast("timestamp").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_utc_timestamps(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def read_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    cols: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Parquet scan with column subset and a half-open time range pushed to the scan.

    The range is compared on the stored type, so it reaches the row-group
    filter also for zone-less columns.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
    dtype = df.schema[ts].dataType.simpleString()
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(dtype))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast(dtype))
    if cols is not None:
        df = df.select(*cols)
    return with_utc_timestamps(df)


def tail(df: DataFrame, key: str | Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows of each key; counting from the end splits hot keys."""
    s = Series(df, key, order)
    return s.running({"__r": ("count", F.lit(1))}, reverse=True).filter(F.col("__r") <= n).drop("__r")


def read_ticks_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``YYYYMMDD HHMMSSmmm,bid,ask,volume`` files with a mid price."""
    raw = spark.read.schema(TICK_CSV_SCHEMA).option("header", header).csv(path)
    return parse_tick_stamps(raw)


def parse_tick_stamps(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.to_timestamp("stamp", TICK_CSV_STAMP).alias("ts"),
        "bid",
        "ask",
        "volume",
        ((F.col("bid") + F.col("ask")) / 2).alias("mid"),
    )


def read_ticks_json(spark: SparkSession, path: str) -> DataFrame:
    """Captured ticks ``{"ms", "p", "b", "a"}``, one JSON object per line."""
    return tick_columns(spark.read.schema(TICK_JSON_SCHEMA).json(path))


def tick_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("p").alias("series_id"),
        F.timestamp_millis("ms").alias("ts"),
        F.col("b").alias("bid"),
        F.col("a").alias("ask"),
        ((F.col("b") + F.col("a")) / 2).alias("mid"),
    )


def read_reports(
    spark: SparkSession,
    paths: str | Sequence[str],
    mapping: dict[str, str],
    entities: dict[str, str],
    entity_col: str,
    date_col: str,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Yearly report files: rename columns, keep listed contracts, one row per (entity, date)."""
    raw = spark.read.option("header", True).csv(paths if isinstance(paths, str) else list(paths))
    return clean_reports(
        raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()]),
        entities,
        entity_col,
        date_col,
        date_format,
    )


def clean_reports(
    df: DataFrame, entities: dict[str, str], entity_col: str, date_col: str, date_format: str
) -> DataFrame:
    lookup = F.create_map(*[F.lit(x) for kv in entities.items() for x in kv])
    others = [c for c in df.columns if c not in (entity_col, date_col)]
    named = df.withColumn(entity_col, lookup[F.col(entity_col)]).withColumn(
        date_col, F.to_date(F.col(date_col).cast("string"), date_format)
    )
    # one deterministic row per (entity, date): the smallest remaining values
    return (
        named.filter(F.col(entity_col).isNotNull() & F.col(date_col).isNotNull())
        .groupBy(entity_col, date_col)
        .agg(F.min(F.struct(*others)).alias("__r"))
        .select(entity_col, date_col, "__r.*")
    )


def read_rates(spark: SparkSession, path: str, entity: str, date: str, rate: str) -> DataFrame:
    """Slow reference rates (policy rates, price levels) with a usable-from instant."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col(entity).alias("entity"),
        F.to_timestamp(F.col(date)).alias("available_at"),
        F.col(rate).cast("double").alias("rate"),
    )


def read_ledger(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Closed trades with predicates left to the scan."""
    df = spark.read.parquet(path)
    return with_utc_timestamps(df.filter(where) if where else df)


def require_available_at(df: DataFrame, col: str = "available_at") -> DataFrame:
    if col not in df.columns:
        raise ValueError(f"causal join needs the column {col!r}: the instant a row becomes known")
    return df


def columns_of(df: DataFrame, cols: str | Sequence[str]) -> list[str]:
    return [c for c in as_list(cols) if c in df.columns]
