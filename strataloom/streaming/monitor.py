"""Streaming IC monitor: events -> daily metric per key -> alerts, and an idempotent upsert sink.

The metric is one stream (windows under a watermark, appended to a table), the alerts another that reads the table: Spark does not chain them in append mode, and each can restart by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "*.parquet", schema=EVENTS) -> DataFrame:
    """Stream of the Parquet files of a folder whose names match files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def daily_metric(events: DataFrame, late: str = "1 day", centre: float = 0.0) -> DataFrame:
    """Mean value less centre per alpha and day, in tumbling windows under a watermark."""
    day = F.window("ts", "1 day")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.col("user_id").cast("string").alias("alpha_id"), day.alias("w")).agg((F.avg("value") - centre).alias("realized_ic")).select("alpha_id", F.col("w.start").alias("ts"), "realized_ic")


ALERT = "alpha_id string, n long, negative_run long, recent_ic double, alert boolean"


def alerts(metric: DataFrame, window: int = 20, streak: int = 10, floor: float = -0.01) -> DataFrame:
    """One row an update of an alpha: state is its run of negative days and its last `window` values, so it is bounded per key."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, run, last = state.get if state.exists else (0, 0, [])
        last = list(last)
        rows = pd.concat(list(frames)).sort_values("ts")
        for v in rows["realized_ic"]:
            n, run = n + 1, run + 1 if v < 0 else 0
            last = [*last, float(v)][-window:]
        state.update((n, run, last))
        recent = sum(last) / len(last)
        yield pd.DataFrame({"alpha_id": [key[0]], "n": [n], "negative_run": [run], "recent_ic": [recent], "alert": [n >= window and (run >= streak or recent < floor)]})

    return metric.groupBy("alpha_id").applyInPandasWithState(step, ALERT, "n long, run long, last array<double>", "append", "NoTimeout")


def upsert_sink(path: str):
    """foreachBatch: keeps one row per (alpha_id, ts) below path, the last batch's; a batch that is run again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["alpha_id", "ts"]).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("alpha_id", "ts").agg(F.max_by("realized_ic", "batch").alias("realized_ic"))


def run_available(df: DataFrame, path: str, checkpoint: str, sink=None, mode: str = "append") -> None:
    """Works off what is there, to Parquet or a foreachBatch sink, and ends."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", path)).start()
    q.awaitTermination()
