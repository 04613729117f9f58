"""Panels made from the star schema: bars by nation and week, brand and week, supplier and month, and from events by user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bars(rows: DataFrame, unit: str) -> DataFrame:
    """rows: ticker, sector and lineitem's columns."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.groupBy(F.date_trunc(unit, "l_shipdate").alias("ts"), "ticker", "sector").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum("l_quantity").alias("volume"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.lit(1.0).alias("adj_factor"),
    )


def nation_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("sector"))
    return _bars(read(spark, sf_dir, "lineitem").join(names, F.col("l_suppkey") == F.col("s_suppkey")), "week")


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"), F.pmod(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"), F.lit(5)).alias("sector"))
    return _bars(read(spark, sf_dir, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey")), "week")


def supp_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    sector = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sector"))
    rows = read(spark, sf_dir, "lineitem").join(sector, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("ticker", F.col("l_suppkey").cast("string"))
    return _bars(rows, "month")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return read(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), F.col("user_id").cast("string").alias("ticker")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    ).withColumnRenamed("day", "ts")


LOADERS = {"nation_week": nation_week, "brand_week": brand_week, "supp_month": supp_month, "event_bars": event_bars}


def register_loader(name: str, load) -> None:
    """load(spark, sf_dir) -> bars (ts, ticker, ...)."""
    LOADERS[name] = load


_MADE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """What make() gives, made once per application and key."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def load_dataset(spark: SparkSession, sf_dir: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A dataset by name, within a range of dates; asked for again, the same one."""
    if name not in LOADERS:
        raise KeyError(f"no dataset {name!r}; there are {sorted(LOADERS)}")

    def make():
        df = LOADERS[name](spark, sf_dir)
        df = df if start is None else df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
        return df if end is None else df.where(F.col("ts") <= F.lit(end).cast("timestamp"))

    return once(spark, (sf_dir, name, start, end), make)


def first_available(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """The first dataset that has rows."""
    for name in names:
        df = load_dataset(spark, sf_dir, name)
        if df.limit(1).count():
            return df
    raise LookupError(f"none of {names} has rows")


def load_many(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Several datasets as one DataFrame with a dataset column."""
    out = None
    for name in names:
        one = load_dataset(spark, sf_dir, name).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
