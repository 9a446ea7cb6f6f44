"""A history with an index of its files: what can matter is read, nothing else.

``append`` writes a batch and then, for each file and key, its rows and first and last
instant to ``_index`` beside the data (a name Spark's readers skip). The index is what makes
a batch visible, so a batch whose write stopped half-way is never seen.

* ``tail`` needs the last n rows of each key: files of a key, newest first, hold n rows from
  some instant on, and only files that reach beyond it are read.
* ``append_new`` drops rows whose key and instant are known: only files whose range of the
  same key overlaps the batch are read for that, and only their identifying columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.plans.series import as_list
from barline.sources.readers import tail


class History:
    """Rows at ``path`` with series ``key`` and instant ``ts``; ``ties`` complete the order."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], ts: str = "ts", ties: Sequence[str] = ()):
        self.spark, self.path, self.key, self.ts, self.ties = spark, path.rstrip("/"), as_list(key), ts, list(ties)
        self.files_read: list[str] | None = None

    def index(self) -> DataFrame | None:
        """(key, file, n, first, last); None before the first batch."""
        try:
            return self.spark.read.parquet(f"{self.path}/_index")
        except AnalysisException:
            return None

    def append(self, batch: DataFrame) -> None:
        """Adds rows; files hold slices of time, so that later reads can leave them out."""
        folder = f"{self.path}/rows-{uuid.uuid4().hex}"
        batch.repartitionByRange(F.col(self.ts)).sortWithinPartitions(*self.key, self.ts).write.parquet(folder)
        rows = self.spark.read.parquet(folder).select(*self.key, self.ts, F.col("_metadata.file_path").alias("file"))
        facts = rows.groupBy(*self.key, "file").agg(F.count(F.lit(1)).alias("n"), F.min(self.ts).alias("first"), F.max(self.ts).alias("last"))
        facts.coalesce(1).write.mode("append").parquet(f"{self.path}/_index")  # a row per file and key of one batch

    def _read(self, files: DataFrame) -> DataFrame | None:
        """The files named by a one-column table: as many as there are files, not rows."""
        self.files_read = sorted(r[0] for r in files.distinct().collect())
        return self.spark.read.parquet(*self.files_read) if self.files_read else None

    def all(self) -> DataFrame | None:
        known = self.index()
        return None if known is None else self._read(known.select("file"))

    def tail(self, n: int) -> DataFrame | None:
        """The last ``n`` rows of each key."""
        known = self.index()
        if known is None:
            return None
        newest = Window.partitionBy(*self.key).orderBy(F.col("first").desc(), "file")
        enough = known.withColumn("__sum", F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
        bound = F.min("first").over(Window.partitionBy(*self.key))
        # the file that completes n rows bounds where they can begin; with fewer rows, all matter
        bound = F.coalesce(F.max(F.when(F.col("__sum") >= n, F.col("first"))).over(Window.partitionBy(*self.key)), bound)
        rows = self._read(enough.withColumn("__from", bound).filter(F.col("last") >= F.col("__from")).select("file"))
        return None if rows is None else tail(rows, self.key, [self.ts, *self.ties], n)

    def append_new(self, batch: DataFrame) -> None:
        """Adds the rows whose key, instant and ties are not there yet, one row each."""
        ids = [*self.key, self.ts, *self.ties]
        batch = batch.dropDuplicates(ids)
        known = self.index()
        if known is not None:
            ranges = batch.groupBy(*self.key).agg(F.min(self.ts).alias("__low"), F.max(self.ts).alias("__high"))
            same = known.join(ranges, self.key).filter((F.col("first") <= F.col("__high")) & (F.col("last") >= F.col("__low")))
            old = self._read(same.select("file"))
            if old is not None:
                batch = batch.join(old.select(*ids), ids, "left_anti")
        self.append(batch)
