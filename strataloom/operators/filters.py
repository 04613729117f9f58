"""Universe filters: one row a ticker, from its last row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import rolling_corr
from .panel import by_ticker


def _last(df: DataFrame, value, name: str) -> DataFrame:
    return df.select("ticker", "ts", value.alias(name)).groupBy("ticker").agg(F.max_by(name, "ts").alias(name))


def _rolling(function, x, w: int, least: int):
    frame = by_ticker().rowsBetween(-(w - 1), 0)
    return F.when(F.count(x).over(frame) >= least, function(x).over(frame))


def _labelled(df: DataFrame, metric: str, cases: list[tuple]) -> DataFrame:
    label = None
    for cond, name in cases:
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return df.withColumn("label", label)


def liquidity(df: DataFrame) -> DataFrame:
    out = _last(df, _rolling(F.avg, F.col("close") * F.col("volume"), 20, 10), "adv20")
    x = F.col("adv20")
    return _labelled(out, "adv20", [(x > 100e6, "ultra"), (x > 50e6, "high"), (x > 10e6, "medium"), (x <= 10e6, "low")])


def volatility(df: DataFrame) -> DataFrame:
    out = _last(df, _rolling(F.stddev_samp, F.col("returns"), 20, 10), "vol20")
    x = F.col("vol20")
    return _labelled(out, "vol20", [(x > 0.04, "high"), (x > 0.02, "medium"), (x <= 0.02, "low")])


def momentum(df: DataFrame) -> DataFrame:
    before = F.lag("close", 60).over(by_ticker())
    out = _last(df, F.when(before != 0, F.col("close") / before - 1), "mom60")
    x = F.col("mom60")
    return _labelled(out, "mom60", [(x > 0.15, "up"), (x < -0.15, "down"), (x.isNotNull(), "flat")])


def with_benchmark(df: DataFrame) -> DataFrame:
    """bench: the mean return of all tickers at each ts."""
    return df.withColumn("bench", F.avg("returns").over(Window.partitionBy("ts")))


def beta(df: DataFrame, w: int = 60, least: int = 20) -> DataFrame:
    frame = by_ticker().rowsBetween(-(w - 1), 0)
    rows = with_benchmark(df).select("ticker", "ts", F.coalesce("returns", F.lit(0.0)).alias("r"), F.coalesce("bench", F.lit(0.0)).alias("b"), F.col("returns").isNotNull().cast("int").alias("ok"))
    var = F.var_samp("b").over(frame)
    value = F.when((F.sum("ok").over(frame) >= least) & (var >= 1e-12), F.covar_samp("r", "b").over(frame) / var)
    out = _last(rows, value, "beta")
    x = F.col("beta")
    return _labelled(out, "beta", [(x > 1.2, "high"), (x < 0.8, "low"), (x.isNotNull(), "neutral")])


def correlation(df: DataFrame, w: int = 60) -> DataFrame:
    frame = by_ticker().rowsBetween(-(w - 1), 0)
    rows = with_benchmark(df)
    out = _last(rows, F.when(F.count("returns").over(frame) >= 20, rolling_corr(F.col("returns"), F.col("bench"), frame)), "corr")
    x = F.col("corr")
    return _labelled(out, "corr", [(x > 0.7, "high"), (x < 0.3, "low"), (x.isNotNull(), "medium")])


def market_cap(caps: DataFrame) -> DataFrame:
    """caps (ticker, cap)."""
    x = F.col("cap")
    return _labelled(caps, "cap", [(x >= 200e9, "mega"), (x >= 10e9, "large"), (x >= 2e9, "mid"), (x < 2e9, "small")])


def earnings_window(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows 0 to 5 days before, or 1 to 5 days after, a date of calendar (ticker, earnings)."""
    days = F.datediff("earnings", "ts")
    return df.join(calendar, "ticker").withColumn("days", days).where((F.col("days") >= -5) & (F.col("days") <= 5)).withColumn("label", F.when(F.col("days") >= 0, "before").otherwise("after"))


def market_regime(df: DataFrame) -> DataFrame:
    """One row: bull, bear or sideways by the benchmark index against its means of 200 and 50 rows. The benchmark has one row a ts, so its one partition is small."""
    index = df.groupBy("ts").agg(F.avg("close").alias("level"))
    w = Window.orderBy("ts")
    rows = index.select("ts", "level", F.avg("level").over(w.rowsBetween(-199, 0)).alias("ma200"), F.avg("level").over(w.rowsBetween(-49, 0)).alias("ma50"), F.row_number().over(w).alias("n"))
    last = rows.agg(*(F.max_by(c, "ts").alias(c) for c in ("level", "ma200", "ma50", "n")))
    side = (F.col("n") < 200) | (F.abs(F.col("level") / F.col("ma50") - 1) < 0.03)
    return last.withColumn("regime", F.when(side, "sideways").when(F.col("level") < F.col("ma200"), "bear").otherwise("bull"))


def combine(labelled: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Tickers that have one of the wanted labels in every filter."""
    for f, wanted in labelled:
        if not wanted:
            raise ValueError("no label wanted")
    return reduce(lambda a, b: a.join(b, "ticker", "left_semi"), [f.where(F.col("label").isin(wanted)).select("ticker") for f, wanted in labelled])
