"""Where the pages of two systems meet: a working table that is bucketed by run and record.

Pages are appended as they are read, in any order and perhaps twice; each row carries its place in the scan. The table's
buckets are those that the comparison groups and joins by, so rows are shuffled once, when a page is recorded, and the
comparison of all pages reads them without an exchange. Of a record that one side gave several times the last place
counts; a side never changes what the other one has given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reconcile import classify, summarize

SIDES = ("source", "target")
KEY = ["run_id", "external_id"]


class WorkingTable:
    """Two tables of the session's catalog below a folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets

    def _table(self, side: str) -> str:
        if side not in SIDES:
            raise ValueError(f"side must be one of {SIDES}")
        return f"{self.name}_{side}"

    def record(self, side: str, rows: DataFrame) -> None:
        """Appends rows of run_id, external_id, fingerprint and place: as one page or many, all or none."""
        dealt = rows.select(*KEY, "fingerprint", F.col("place").cast("long")).repartition(self.buckets, *KEY)
        writer = dealt.write.mode("append").format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{self.path}/{side}").saveAsTable(self._table(side))

    def _side(self, side: str) -> DataFrame:
        if not self.spark.catalog.tableExists(self._table(side)):
            empty = self.spark.createDataFrame([], "run_id string, external_id string, fingerprint string, place long")
            self.record(side, empty)
        last = F.max_by("fingerprint", F.struct("place", "fingerprint"))
        return self.spark.table(self._table(side)).groupBy(*KEY).agg(last.alias(f"{side}_fingerprint")).withColumn(f"{side}_seen", F.lit(True))

    def items(self) -> DataFrame:
        """A row for each run and record: both flags, both fingerprints, the result."""
        both = self._side("source").join(self._side("target"), KEY, "full_outer")
        seen = {f"{s}_seen": F.coalesce(f"{s}_seen", F.lit(False)) for s in SIDES}
        both = both.withColumns(seen)
        return both.withColumn("result", classify(F.col("source_seen"), F.col("target_seen"), F.col("source_fingerprint") == F.col("target_fingerprint")))

    def summary(self) -> DataFrame:
        """The six counts of each run."""
        return summarize(self.items(), "run_id")

    def drop(self) -> None:
        for side in SIDES:
            self.spark.sql(f"drop table if exists {self._table(side)}")
