"""The change feed as a stream: a table of documents kept up to date from file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import forget, upsert


def quiet_changes(changes: DataFrame, *, key: str, at: str, action: str, quiet_us: int = 800_000, late: str = "10 minutes") -> DataFrame:
    """(key, action, at): the last change of each run of changes less than ``quiet_us`` apart, once the run is over.

    Runs are session windows, which also join what is exactly their gap apart; a run is passed on when the watermark has left it
    behind, changes later than ``late`` are dropped by it.
    """
    runs = changes.withWatermark(at, late).groupBy(F.session_window(at, f"{quiet_us - 1} microseconds"), key)
    return runs.agg(F.max_by(action, at).alias(action), F.max(at).alias(at)).select(key, action, at)


def counts_by_window(changes: DataFrame, *, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes per tumbling window and value."""
    return changes.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def keep_table(changes: DataFrame, path: str, checkpoint: str, *, key: str, action: str, removed: str = "delete") -> StreamingQuery:
    """Start a query that applies every batch of changes to the table under ``path``.

    A batch writes the table's next state beside the last and names it in the
    batch's own folder, so a batch that is run again after a failure starts
    from the same state and gives the same table.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        states = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(hadoop)] if files.exists(hadoop) else []
        before = [s for s in states if s < number]
        old = spark.read.parquet(f"{path}/state={max(before)}") if before else batch.limit(0)
        gone = batch.filter(F.col(action) == removed)
        upsert(forget(old, gone, [key]), batch.filter(F.col(action) != removed), [key]).write.mode("overwrite").parquet(f"{path}/state={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
