"""The signal pipeline: truncate, decay, neutralise, delay, in this order, and the burn-in trim. Frames have (keys..., ts, ticker, signal)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crosssection as cs
from ..functions import timeseries as tsf


@dataclass(frozen=True)
class SignalConfig:
    delay: int = 1
    decay: int = 0
    q_min: float = 0.05
    q_max: float = 0.95
    group: str | None = None
    top: float = 0.1
    mode: str = "long_short"
    max_weight: float | None = None

    def __post_init__(self):
        wrong = [
            m
            for ok, m in (
                (self.delay >= 0, "delay below 0"),
                (self.decay >= 0, "decay below 0"),
                (0 <= self.q_min < 0.5, "q_min outside [0, 0.5)"),
                (0.5 < self.q_max <= 1, "q_max outside (0.5, 1]"),
                (0 < self.top < 0.5, "top outside (0, 0.5)"),
                (self.mode in ("long_short", "decile", "mvo"), f"mode {self.mode!r}"),
            )
            if not ok
        ]
        if wrong:
            raise ValueError("; ".join(wrong))


def by_time(*keys: str):
    return Window.partitionBy(*keys, "ts")


def by_ticker(*keys: str):
    return Window.partitionBy(*keys, "ticker").orderBy("ts")


def truncate(df: DataFrame, low: float = 0.05, high: float = 0.95, keys=()) -> DataFrame:
    s, w = F.col("signal"), by_time(*keys)
    return df.withColumn("signal", F.when(s.isNotNull(), F.least(F.greatest(s, F.percentile(s, F.lit(low)).over(w)), F.percentile(s, F.lit(high)).over(w))))


def decay(df: DataFrame, window: int, keys=()) -> DataFrame:
    return df.withColumn("signal", tsf.ts_decay_linear(F.col("signal"), window, by_ticker(*keys))) if window > 1 else df


def neutralise(df: DataFrame, group: str, keys=()) -> DataFrame:
    return df.withColumn("signal", cs.demean(F.col("signal"), Window.partitionBy(*keys, "ts", group)))


def delay(df: DataFrame, rows: int, keys=()) -> DataFrame:
    return df.withColumn("signal", F.lag("signal", rows).over(by_ticker(*keys))) if rows else df


def process(df: DataFrame, config: SignalConfig, keys=()) -> DataFrame:
    df = decay(truncate(df, config.q_min, config.q_max, keys), config.decay, keys)
    if config.group:
        df = neutralise(df, config.group, keys)
    return delay(df, config.delay, keys)


def post_process(df: DataFrame, winsorize: float | None = None, centre: bool = False, keys=()) -> DataFrame:
    """What may follow an expression: per ts, winsorising to k deviations, then taking the mean off."""
    if winsorize is not None:
        if winsorize <= 0:
            raise ValueError("winsorize is not above 0")
        df = df.withColumn("signal", cs.winsorize(F.col("signal"), by_time(*keys), winsorize))
    return df.withColumn("signal", cs.demean(F.col("signal"), by_time(*keys))) if centre else df


def trim_burn_in(df: DataFrame) -> DataFrame:
    """Without the rows before the first ts that has a signal."""
    first = df.where("signal IS NOT NULL").agg(F.min("ts").alias("_first"))
    return df.join(F.broadcast(first), F.col("ts") >= F.col("_first")).drop("_first")
