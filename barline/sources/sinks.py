"""Writers: append, de-duplicated append, upsert, prune, result files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.plans.series import as_list
from barline.session import shared_dir
from barline.sources.readers import with_utc_timestamps


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where one expensive table feeds several branches of a plan; unlike a
    cache it survives lost executors.
    """
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append-only history."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def new_rows(df: DataFrame, existing: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not present yet, one row per key."""
    keys = as_list(keys)
    return df.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def append_dedup(df: DataFrame, path: str, keys: str | Sequence[str]) -> None:
    """Idempotent append: a second write of the same keys adds nothing."""
    old = _existing(df.sparkSession, path)
    append(df.dropDuplicates(as_list(keys)) if old is None else new_rows(df, old, keys), path)


def newest_by_key(df: DataFrame, keys: str | Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key by an aggregate with map-side combine (no sorted window)."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
        .select(*keys, "__r.*")
    )


def upsert(df: DataFrame, path: str, keys: str | Sequence[str], version: Sequence[str], partition: str) -> None:
    """Insert or replace by key; only the date partitions the new rows touch are rewritten.

    ``partition`` must be a function of the keys, so a key never moves partition.
    """
    spark = df.sparkSession
    rows = df.withColumn("__new", F.lit(1))
    old = _existing(spark, path)
    if old is not None:
        # Spark picks the join by the measured size of the list of dates
        old = with_utc_timestamps(old).join(df.select(partition).distinct(), partition, "left_semi")
        rows = old.withColumn("__new", F.lit(0)).unionByName(rows)
    merged = newest_by_key(rows, keys, [*version, "__new"]).select(*df.columns)
    if old is not None:
        # a table being read cannot be overwritten: stage beside it first, under a name of
        # this call, so that two writers do not share it
        staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
        merged.write.parquet(staged)
        merged = spark.read.parquet(staged)
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def prune(spark: SparkSession, path: str, partition: str, keep_from: str) -> DataFrame:
    """Rows kept by the retention rule, reading only the kept date partitions."""
    return spark.read.parquet(path).filter(F.col(partition) >= F.lit(keep_from))


def prune_in_place(spark: SparkSession, path: str, partition: str, keep_from: str) -> None:
    """Drop expired date partitions by deleting their directories."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(hpath):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{partition}="):
            if name.split("=", 1)[1] < keep_from:
                fs.delete(status.getPath(), True)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result tables as Parquet or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
