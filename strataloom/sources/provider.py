"""Providers of long panels, and a registry with a fallback chain."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import materialise

SCHEMA = "ts timestamp, ticker string, open double, high double, low double, close double, volume double, vwap double, returns double"


class Provider(Protocol):
    def fetch_panel(self, spark: SparkSession, tickers: list[str] | None, start: str, end: str, fields: list[str] | None = None) -> DataFrame: ...


class LocalParquet:
    """A folder partitioned by ticker and year; both prune, as do fields and dates."""

    def __init__(self, root: str):
        self.root = root

    def fetch_panel(self, spark, tickers, start, end, fields=None):
        df = spark.read.parquet(self.root)
        a, b = (F.lit(x).cast("timestamp") for x in (start, end))
        df = df.where((F.col("year") >= F.year(a)) & (F.col("year") <= F.year(b)) & (F.col("ts") >= a) & (F.col("ts") <= b))
        if tickers is not None:
            df = df.where(F.col("ticker").isin(tickers))
        return df.select("ts", "ticker", *(fields or [c for c in df.columns if c not in ("ts", "ticker", "year")]))

    def save(self, df: DataFrame) -> None:
        """Writes (ts, ticker, ...); of a key that is there already the new row stays. Only the tickers and years that df has are rewritten, from a staged copy."""
        spark, df = df.sparkSession, df.withColumn("year", F.year("ts"))
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            touched = F.broadcast(df.select("ticker", "year").distinct())  # a row a partition of df
            old = spark.read.parquet(self.root).join(touched, ["ticker", "year"]).join(df.select("ts", "ticker"), ["ts", "ticker"], "left_anti")
            df = materialise(old.unionByName(df, allowMissingColumns=True))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker", "year").parquet(self.root)


class SyntheticSource(DataSource):
    """spark.read.format('strataloom_synthetic').options(tickers=20, rows=120, seed=42): seeded random walks, for tests. One partition a ticker, each from its own seed."""

    @classmethod
    def name(cls):
        return "strataloom_synthetic"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _SyntheticReader(int(self.options.get("tickers", 20)), int(self.options.get("rows", 120)), int(self.options.get("seed", 42)))


class _SyntheticReader(DataSourceReader):
    def __init__(self, tickers: int, rows: int, seed: int):
        self.tickers, self.rows, self.seed = tickers, rows, seed

    def partitions(self):
        return [InputPartition(i) for i in range(self.tickers)]

    def read(self, partition):
        from datetime import datetime, timedelta

        import numpy as np

        rng = np.random.default_rng([self.seed, partition.value])
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, self.rows)))
        day, before = datetime(2022, 1, 3), None
        for c in close:
            while day.weekday() > 4:
                day += timedelta(1)
            high, low = c * (1 + rng.uniform(0, 0.02)), c * (1 - rng.uniform(0, 0.02))
            opened = before if before is not None else c
            yield (day, f"T{partition.value:03d}", float(opened), float(max(high, opened)), float(min(low, opened)), float(c), float(rng.integers(500_000, 5_000_000)), float((high + low + c) / 3), 0.0 if before is None else float(c / before - 1))
            before, day = c, day + timedelta(1)


class Synthetic:
    def __init__(self, tickers: int = 20, rows: int = 120, seed: int = 42):
        self.options = {"tickers": str(tickers), "rows": str(rows), "seed": str(seed)}

    def fetch_panel(self, spark, tickers, start, end, fields=None):
        spark.dataSource.register(SyntheticSource)
        df = spark.read.format("strataloom_synthetic").options(**self.options).load()
        df = df.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))
        if tickers is not None:
            df = df.where(F.col("ticker").isin(tickers))
        return df.select("ts", "ticker", *fields) if fields else df


PROVIDERS: dict[str, Provider] = {"synthetic": Synthetic()}


def register_provider(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def fetch(spark: SparkSession, chain: list[str], tickers: list[str] | None, start: str, end: str) -> DataFrame:
    """The first provider of the chain that gives rows. Nothing is substituted: if none does, that is an error that names each reason."""
    reasons = []
    for name in chain:
        try:
            df = PROVIDERS[name].fetch_panel(spark, tickers, start, end)
            if df.limit(1).count():
                return df
            reasons.append(f"{name}: no rows")
        except Exception as e:  # the next provider may do
            reasons.append(f"{name}: {type(e).__name__}")
    raise LookupError("; ".join(reasons) or "no provider")


#: Named universes: dataset and tickers.
UNIVERSES = {
    "all_nations": ("nation_week", None),
    "first_nations": ("nation_week", ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]),
    "brands": ("brand_week", None),
    "suppliers": ("supp_month", None),
    "users": ("event_bars", None),
}
