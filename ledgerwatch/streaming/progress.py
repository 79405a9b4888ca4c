"""How long streams take, as a table: a listener keeps a row for each stage of each batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import windows

SCHEMA = "query string, run string, batch long, at string, stage string, took_ms long, rows long"


class ProgressListener(StreamingQueryListener):
    """Rows wait on the driver, ``most`` at most, until they are written as a file of the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1_000):
        super().__init__()
        self.spark, self.path, self.most, self.rows, self.lock = spark, path, most, [], threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            self.rows += [(p.name or str(p.id), str(p.runId), int(p.batchId), p.timestamp, stage, int(ms), int(p.numInputRows)) for stage, ms in p.durationMs.items()]
        if len(self.rows) >= self.most:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Percentiles, least, greatest and mean of each stage's time, by query and stage."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    named = rows.withColumn("of", F.concat_ws("/", "query", "stage"))
    return windows.latency_percentiles(named, "of", "took_ms").select(F.split("of", "/")[0].alias("query"), F.split("of", "/")[1].alias("stage"), "*").drop("of")


def throughput(spark: SparkSession, path: str) -> DataFrame:
    """Rows and batches of each query, and rows a second of its batches' time."""
    rows = spark.read.schema(SCHEMA).parquet(path).filter("stage = 'triggerExecution'")
    return rows.groupBy("query").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.expr("sum(rows) * 1000.0D / greatest(sum(took_ms), 1)").alias("rows_per_second"))
