"""Helpers the operators share: tables, whole texts, checks of names, tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import shared_dir

#: ASCII white space, the only separators of words.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text itself; a null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def hash60(*parts: Column | str) -> Column:
    """60 bits of an MD5, as a long: a draw that SQL engines can repeat."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def hash60_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read back: lineage is cut and a
    lost executor loses nothing. ``drop_tables`` removes it when its reader is done."""
    path = shared_dir(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop_tables(*kept: DataFrame) -> None:
    """Delete tables of ``keep_table`` that no later plan reads."""
    for df in kept:
        if path := getattr(df, "kept_at", None):
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
