"""Counts of a stream kept as a table: what a batch changed is written under the batch's number, so a repeated batch counts once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class LatestCounts:
    """A table of (term, count) in a folder that all executors share, kept by a stream in update mode.

    Each batch brings the terms whose counts it changed, with their counts by then; they go to the folder of the batch's number and replace
    what an earlier try left there. A term's count is that of its last batch. Every ``merge_every`` batches all is
    merged into one base, dealt into buckets of terms; readers take the newest whole base and the batches after it.
    """

    spark: SparkSession
    path: str
    merge_every: int = 20

    def _folders(self) -> tuple[int, list[int]]:
        """The newest base's batch (-1 for none) and the batches after it."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return -1, []
        names = [s.getPath().getName() for s in store.listStatus(root) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        base = max((int(n[5:]) for n in names if n.startswith("base-")), default=-1)
        return base, sorted(b for b in (int(n[6:]) for n in names if n.startswith("batch-")) if b > base)

    def put(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        base, later = self._folders()
        if number <= base:
            return  # a repeat of what is merged already
        batch.select("term", "count").write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if len(later) + 1 >= self.merge_every:
            self._merged(number).repartition(F.xxhash64("term")).write.mode("overwrite").parquet(f"{self.path}/base-{number}")

    def _merged(self, upto: int | None = None) -> DataFrame:
        base, later = self._folders()
        parts = [(base, f"{self.path}/base-{base}")] if base >= 0 else []
        parts += [(n, f"{self.path}/batch-{n}") for n in later if upto is None or n <= upto]
        out = self.spark.createDataFrame([], "term string, count bigint, number bigint")
        for n, path in parts:
            out = out.unionAll(self.spark.read.schema("term string, count bigint").parquet(path).withColumn("number", F.lit(n).cast("long")))
        return out.groupBy("term").agg(F.max_by("count", "number").alias("count"))

    def read(self) -> DataFrame:
        """(term, count) by now."""
        return self._merged()


def kept_up(counts: DataFrame, table: LatestCounts, state: str) -> None:
    """Runs a stream of (term, count) over all that is there now. ``state``: the folder of its checkpoint, by which it goes on where it stopped."""
    q = counts.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(table.put).trigger(availableNow=True).start()
    q.awaitTermination()
