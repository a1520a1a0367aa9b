"""A stream of writes (key, value, seq) folded into a key-value table: each micro-batch is one upsert plan into a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemill.operators import kv


class SnapshotTable:
    """The newest snapshot of a key-value table in a folder; a batch that is run again after a failure writes the same snapshot."""

    def __init__(self, start: DataFrame, folder: str) -> None:
        self.spark, self.schema, self.folder, self.current = start.sparkSession, start.schema, folder, start

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        path = f"{self.folder}/snapshot-{batch_id:012d}"
        kv.put(self.current, batch).write.mode("overwrite").parquet(path)
        self.current = self.spark.read.schema(self.schema).parquet(path)


def upserts(changes: DataFrame, into: SnapshotTable, checkpoint: str) -> DataStreamWriter:
    return changes.writeStream.foreachBatch(into.apply).option("checkpointLocation", checkpoint)


def running_counts(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Counts per window and key, final once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
