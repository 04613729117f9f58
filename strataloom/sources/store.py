"""Parquet feature store by year, metadata, and the ledger tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one, which is then set; on a cluster that is an error, since executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what several results read is made once, and a lost executor costs a stage."""
    path = f"{shared_dir(df.sparkSession)}/made/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_features(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (ts, ticker, ...) partitioned by year; append merges with what is there, the new row of a key wins. Only the years that df has are rewritten."""
    spark = df.sparkSession
    df = df.withColumn("year", F.year("ts"))
    if mode == "append" and exists(spark, path):
        years = [r.year for r in df.select("year").distinct().collect()]  # a handful: one per year of data
        old = spark.read.parquet(path).where(F.col("year").isin(years))
        both = old.withColumn("_new", F.lit(0)).unionByName(df.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        last = F.row_number().over(Window.partitionBy("ts", "ticker").orderBy(F.col("_new").desc()))
        df = both.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_new")
        staged = f"{path.rstrip('/')}__staged"
        df.write.mode("overwrite").partitionBy("year").parquet(staged)
        df = spark.read.parquet(staged)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if mode == "append" else "static").partitionBy("year").parquet(path)


def load_features(spark: SparkSession, path: str, start=None, end=None, tickers: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Prunes years by partition, fields and dates by pushdown."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("year") >= F.year(F.lit(start).cast("timestamp"))) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end is not None:
        df = df.where((F.col("year") <= F.year(F.lit(end).cast("timestamp"))) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    if tickers is not None:
        df = df.where(F.col("ticker").isin(tickers))
    return df.select("ts", "ticker", *fields) if fields else df.drop("year")


def metadata(df: DataFrame) -> DataFrame:
    """One row: start, end, tickers (count) and rows."""
    return df.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.countDistinct("ticker").alias("n_tickers"), F.count(F.lit(1)).alias("n_rows"))


def merged_metadata(stored: dict, new: dict) -> dict:
    """Union of two descriptions (start_ts, end_ts, tickers, fields): the wider range, all tickers and fields."""
    out = {"start_ts": min(x for x in (stored.get("start_ts"), new.get("start_ts")) if x), "end_ts": max(x for x in (stored.get("end_ts"), new.get("end_ts")) if x)}
    return out | {k: sorted({*stored.get(k, ()), *new.get(k, ())}) for k in ("tickers", "fields")}


def covers(df: DataFrame, start, end, tickers: list[str]) -> bool:
    """Whether a stored panel has the range and the tickers."""
    row = df.agg(F.min("ts") <= F.lit(start).cast("timestamp"), F.max("ts") >= F.lit(end).cast("timestamp"), F.countDistinct(F.when(F.col("ticker").isin(tickers), F.col("ticker")))).first()
    return bool(row[0] and row[1] and row[2] == len(set(tickers)))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metadata(df: DataFrame) -> str:
    r = metadata(df).first()
    return json.dumps({k: str(v) for k, v in r.asDict().items()}, sort_keys=True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
