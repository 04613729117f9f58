"""Data-quality operators on a dense panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_ticker


def gaps(df: DataFrame, least: int = 1) -> DataFrame:
    """Runs of rows without a close, of `least` rows or more."""
    rows = df.select("ticker", "ts", F.col("close").isNull().alias("gap"), F.row_number().over(by_ticker()).alias("rn"))
    island = F.col("rn") - F.row_number().over(Window.partitionBy("ticker").orderBy("ts"))
    runs = rows.where("gap").withColumn("island", island)
    return runs.groupBy("ticker", "island").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("island")


def spikes(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    before = F.lag("close").over(by_ticker())
    return df.select("ts", "ticker", F.when(before != 0, F.col("close") / before - 1).alias("change")).where(F.abs("change") > threshold)


def zero_volume(df: DataFrame) -> DataFrame:
    return df.where("volume IS NULL OR volume = 0").select("ts", "ticker", "volume")


def health_score(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: the shares of rows with a close, without a spike, with volume, and outside gaps; and their mean, to 4 places."""
    before = F.lag("close").over(by_ticker())
    flagged = df.select("close", "volume", F.coalesce(F.abs(F.when(before != 0, F.col("close") / before - 1)) > threshold, F.lit(False)).alias("spike"), (F.col("close").isNull() & F.lag("close").over(by_ticker()).isNull()).alias("long_gap"))
    n = F.count(F.lit(1))
    parts = flagged.agg((F.count("close") / n).alias("filled"), (1 - F.count_if("spike") / n).alias("calm"), (1 - F.count_if(F.coalesce(F.col("volume") == 0, F.lit(True))) / n).alias("traded"), (1 - F.count_if("long_gap") / n).alias("unbroken"))
    return parts.withColumn("score", F.round((F.col("filled") + F.col("calm") + F.col("traded") + F.col("unbroken")) / 4, 4))
