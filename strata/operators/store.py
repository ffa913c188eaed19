"""Tables that grow by epochs in a shared folder (S4, S6, J9): what is there is never made again.

An epoch's rows go to a folder of their own, which a replay of the epoch overwrites, so nothing is written twice. Only
keys that earlier epochs lack are appended (an anti-join on the key), so the first row of a key stays. ``compact`` writes
all epochs as one table sorted by key; later reads take it and the epochs behind it. Which folders count is told by a log
table (one row an epoch or compaction). Superseded folders stay where they are for readers that began before.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "folder string, upto long, whole boolean"


class EpochTable:
    """Rows by epoch; the column ``epoch`` tells which one a row came with."""

    def __init__(self, spark: SparkSession, path: str, sort_by: list[str]):
        self.spark, self.path, self.sort_by = spark, path, sort_by

    def _folders(self) -> list[str]:
        try:
            log = self.spark.read.schema(LOG).parquet(os.path.join(self.path, "_log")).distinct().collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        whole = max((r for r in log if r["whole"]), key=lambda r: r["upto"], default=None)
        behind = [r["folder"] for r in log if not r["whole"] and (whole is None or r["upto"] > whole["upto"])]
        return ([whole["folder"]] if whole else []) + sorted(behind)

    def _write(self, rows: DataFrame, folder: str, upto: int, whole: bool) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.path, folder))
        self.spark.createDataFrame([(folder, upto, whole)], LOG).coalesce(1).write.mode("append").parquet(os.path.join(self.path, "_log"))

    def append(self, rows: DataFrame, epoch: int) -> None:
        self._write(rows.withColumn("epoch", F.lit(epoch).cast("long")), f"epoch-{epoch:012d}", epoch, False)

    def read(self, before: int | None = None) -> DataFrame | None:
        """All rows (of epochs before the given one), or None if nothing was written yet."""
        folders = self._folders()
        if not folders:
            return None
        rows = self.spark.read.parquet(*[os.path.join(self.path, f) for f in folders])
        return rows if before is None else rows.where(F.col("epoch") < before)

    def compact(self) -> None:
        """One table of all epochs, range-partitioned and sorted; replays of epochs before it are no longer possible."""
        rows = self.read()
        if rows is not None:
            last = rows.agg(F.max("epoch")).first()[0]
            if last is not None:
                self._write(rows.repartitionByRange(*self.sort_by).sortWithinPartitions(*self.sort_by), f"whole-{last:012d}", last, True)


class KeyedStore(EpochTable):
    """One row a key: of repeated keys the first epoch's, within an epoch the least by the other columns."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        super().__init__(spark, path, [key])
        self.key = key

    def missing(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows whose key the store lacks (J9's misses)."""
        known = self.read(before)
        return rows if known is None else rows.join(known.select(self.key), self.key, "left_anti")

    def append(self, rows: DataFrame, epoch: int) -> None:
        others = [c for c in rows.columns if c != self.key]
        fresh = self.missing(rows, epoch).groupBy(self.key).agg(F.min(F.struct(*others)).alias("__first"))
        super().append(fresh.select(self.key, *[F.col("__first")[c].alias(c) for c in others]), epoch)
