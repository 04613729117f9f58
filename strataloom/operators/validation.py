"""In-sample / out-of-sample segments, walk-forward folds, several datasets, input checks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def business_axis(start: date, end: date) -> list[date]:
    return [start + timedelta(i) for i in range((end - start).days + 1) if (start + timedelta(i)).weekday() < 5]


def split_bounds(axis: list, oos: float = 0.3, embargo: int = 20) -> tuple:
    """(first ts that is not IS, first ts that is OOS) on an ordered axis."""
    n_is = round(len(axis) * (1 - oos))
    if not 0 < n_is < len(axis) or n_is + embargo >= len(axis):
        raise ValueError(f"{len(axis)} dates do not hold a split of {oos} with an embargo of {embargo}")
    return axis[n_is], axis[n_is + embargo]


def ordered_axis(df: DataFrame) -> DataFrame:
    """(ts, i) of the observed dates. One row a date, so its one partition is small."""
    return df.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)


def with_segment(df: DataFrame, oos: float = 0.3, embargo: int = 20) -> DataFrame:
    """segment IS, EMBARGO or OOS by the observed axis."""
    axis = ordered_axis(df)
    total = axis.agg(F.count(F.lit(1)).alias("total"))
    axis = axis.crossJoin(F.broadcast(total)).withColumn("n_is", F.round(F.col("total") * (1 - oos)).cast("int"))
    label = F.when(F.col("i") < F.col("n_is"), "IS").when(F.col("i") < F.col("n_is") + embargo, "EMBARGO").otherwise("OOS")
    return df.join(F.broadcast(axis.select("ts", label.alias("segment"))), "ts")


def with_ratio_split(df: DataFrame, ratio: float = 0.7) -> DataFrame:
    axis = ordered_axis(df)
    n = axis.agg(F.floor(F.count(F.lit(1)) * ratio).alias("k"))
    return df.join(F.broadcast(axis.crossJoin(F.broadcast(n)).select("ts", F.when(F.col("i") < F.col("k"), "IS").otherwise("OOS").alias("segment"))), "ts")


def folds(n_dates: int, k: int = 5, min_train: int = 120, embargo: int = 20) -> list[tuple[int, int, int, int, int]]:
    """(fold, is_start, is_end, oos_start, oos_end) as inclusive positions on the axis: the training part grows, each test part is equally long; none if a test part would have fewer than 5 dates."""
    size = (n_dates - min_train - embargo) // k
    if size < 5:
        return []
    return [(i, 0, min_train + i * size - 1, min_train + i * size + embargo, min_train + (i + 1) * size + embargo - 1) for i in range(k)]


def with_folds(df: DataFrame, k: int = 5, min_train: int = 120, embargo: int = 20) -> DataFrame:
    """A row for each fold and segment that a row of df belongs to: a range join with the table of k folds."""
    axis = ordered_axis(df)
    table = folds(axis.count(), k, min_train, embargo)
    spark = df.sparkSession
    bounds = spark.createDataFrame([(i, s, a, b) for i, a0, a1, b0, b1 in table for s, a, b in (("IS", a0, a1), ("OOS", b0, b1))], "fold int, segment string, lo int, hi int")
    dated = axis.join(F.broadcast(bounds), (F.col("i") >= F.col("lo")) & (F.col("i") <= F.col("hi"))).select("ts", "fold", "segment")
    return df.join(F.broadcast(dated), "ts")


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """per_fold: fold, segment, sharpe. Mean, deviation and least of the OOS Sharpe ratios, share above 0, mean overfit (0 to 1)."""
    rows = per_fold.groupBy("fold").pivot("segment", ["IS", "OOS"]).agg(F.first("sharpe"))
    gap = F.try_divide(F.col("IS") - F.col("OOS"), F.abs("IS"))
    return rows.where("OOS IS NOT NULL").agg(F.avg("OOS").alias("mean_oos"), F.stddev_pop("OOS").alias("std_oos"), F.min("OOS").alias("min_oos"), F.avg((F.col("OOS") > 0).cast("double")).alias("positive"), F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), gap))).alias("overfit"))


def across_datasets(per: DataFrame) -> DataFrame:
    """per: dataset, sharpe, n_oos. Mean, least and mean weighted by the square root of n_oos."""
    w = F.sqrt(F.col("n_oos").cast("double"))
    return per.agg(F.avg("sharpe").alias("mean_sharpe"), F.min("sharpe").alias("min_sharpe"), F.try_divide(F.sum(F.col("sharpe") * w), F.sum(w)).alias("weighted_sharpe"))


def check_panel(df: DataFrame) -> None:
    """Raises unless df has ts, ticker and a close, and no key twice."""
    missing = {"ts", "ticker", "close"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    if dict(df.dtypes)["ts"] not in ("timestamp", "date", "timestamp_ntz"):
        raise ValueError("ts is no timestamp")
    found = df.groupBy("ts", "ticker").count().where("count > 1").limit(1).collect()
    if found:
        raise ValueError(f"key given twice: {found[0].ts}, {found[0].ticker}")
    if not df.where("close IS NOT NULL").limit(1).count():
        raise ValueError("no close")
