"""Portfolio construction and trading costs. Frames have (keys..., ts, ticker, weight) and what the operator names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signal import by_ticker, by_time


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 5.0
    minimum: float = 1.0
    spread_bps: float = 2.0
    impact: float = 0.1
    adv_window: int = 20
    adv_cap: float = 0.1
    borrow: float = 0.005
    capital: float = 1e6


def l1(w: Column, spec) -> Column:
    total = F.sum(F.abs(w)).over(spec)
    return F.when(total > 0, w / total).otherwise(0.0)


def decile(df: DataFrame, top: float = 0.1, bottom: float | None = None, keys=()) -> DataFrame:
    """1 / n_long at or above the upper quantile, -1 / n_short at or below the lower one (which wins where both hold); all 0 at a ts with fewer than two signals."""
    s, w = F.col("signal"), by_time(*keys)
    df = df.withColumns({"_long": F.coalesce(s >= F.percentile(s, F.lit(1 - top)).over(w), F.lit(False)), "_short": F.coalesce(s <= F.percentile(s, F.lit(bottom or top)).over(w), F.lit(False)), "_n": F.count(s).over(w)})
    weight = F.when(F.col("_n") < 2, 0.0).when(F.col("_short"), -1 / F.count_if("_short").over(w)).when(F.col("_long"), 1 / F.count_if("_long").over(w)).otherwise(0.0)
    return df.withColumn("weight", weight).drop("_long", "_short", "_n")


def signal_weighted(df: DataFrame, keys=()) -> DataFrame:
    """z score, null as 0, clipped to 3, absolute weights adding up to 1."""
    s, w = F.col("signal"), by_time(*keys)
    sd = F.stddev_samp(s).over(w)
    z = F.coalesce(F.when(sd != 0, (s - F.avg(s).over(w)) / sd), F.lit(0.0))
    df = df.withColumn("_z", F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0)))
    return df.withColumn("weight", l1(F.col("_z"), w)).drop("_z")


def _neutral(df: DataFrame, value: Column, keys) -> DataFrame:
    return df.withColumn("_v", value).withColumn("weight", l1(F.col("_v"), by_time(*keys))).drop("_v")


def market_neutral(df: DataFrame, keys=()) -> DataFrame:
    return _neutral(df, F.col("weight") - F.avg("weight").over(by_time(*keys)), keys)


def industry_neutral(df: DataFrame, group: str = "sector", keys=()) -> DataFrame:
    """Rows without a group are a group of their own."""
    g = F.coalesce(F.col(group).cast("string"), F.lit("__other__"))
    return _neutral(df, F.col("weight") - F.avg("weight").over(Window.partitionBy(*keys, "ts", g)), keys)


def with_beta(df: DataFrame, window: int = 60, least: int = 10, keys=()) -> DataFrame:
    """beta of returns to the mean return of each ts, over the rows before this one: sample covariance over population variance; 1 with fewer than `least` rows."""
    df = df.withColumn("_m", F.avg("returns").over(by_time(*keys)))
    df = df.withColumns({"_r": F.when(F.col("_m").isNotNull(), F.col("returns")), "_mm": F.when(F.col("returns").isNotNull(), F.col("_m"))})
    frame = by_ticker(*keys).rowsBetween(-window, -1)
    var = F.var_pop("_mm").over(frame)
    return df.withColumn("beta", F.when((F.count("_r").over(frame) >= least) & (var > 1e-12), F.covar_samp("_r", "_mm").over(frame) / var).otherwise(1.0)).drop("_m", "_r", "_mm")


def beta_neutral(df: DataFrame, keys=()) -> DataFrame:
    """Takes weight and beta."""
    w = by_time(*keys)
    return _neutral(df, F.col("weight") - F.sum(F.col("weight") * F.col("beta")).over(w) / F.count(F.lit(1)).over(w), keys)


def cap_weight(df: DataFrame, cap: float, keys=()) -> DataFrame:
    """Cut to the cap, then scaled to 1, which may lift weights over the cap again."""
    return _neutral(df, F.signum("weight") * F.least(F.abs("weight"), F.lit(cap)), keys)


def with_adv(df: DataFrame, window: int = 20, least: int = 10, keys=()) -> DataFrame:
    """Mean traded value of `window` rows, before the first one the next known, else 0."""
    value, spec = F.col("volume") * F.col("close"), by_ticker(*keys)
    frame = spec.rowsBetween(-(window - 1), 0)
    df = df.withColumn("_adv", F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame)))
    later = F.first("_adv", ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("adv", F.coalesce(later, F.lit(0.0))).drop("_adv")


def cap_adv(df: DataFrame, costs: Costs = Costs(), keys=()) -> DataFrame:
    """Takes weight and adv."""
    return _neutral(df, F.signum("weight") * F.least(F.abs("weight"), costs.adv_cap * F.col("adv") / costs.capital), keys)


def slippage_bps(trade: Column, adv: Column, vol: Column, costs: Costs = Costs(), model: str = "sqrt") -> Column:
    """Half the spread and the impact of a trade of this value; 0 without a trade."""
    if model == "linear":
        bps = costs.spread_bps / 2 + 0.1 * vol * 1e4
    else:
        share = F.when(adv > 0, trade / adv).otherwise(0.0)
        bps = costs.spread_bps / 2 + costs.impact * vol * 1e4 * F.sqrt(share)
    return F.when(trade > 0, bps).otherwise(0.0)


def trade_cost(trade: Column, bps: Column, costs: Costs = Costs()) -> Column:
    return F.when(trade > 0, F.greatest(trade * (costs.commission_bps + bps) / 1e4, F.lit(costs.minimum))).otherwise(0.0)


def trade_log(df: DataFrame, costs: Costs = Costs(), keys=()) -> DataFrame:
    """One row a trade at costs.capital; takes weight, close, adv, vol."""
    change = F.col("weight") - F.coalesce(F.lag("weight").over(by_ticker(*keys)), F.lit(0.0))
    rows = df.withColumn("_dw", change).where((F.abs("_dw") >= 1e-10) & (F.col("close") > 0))
    trade = F.abs("_dw") * costs.capital
    rows = rows.withColumn("slippage_bps", slippage_bps(trade, F.col("adv"), F.col("vol"), costs))
    side = F.when(F.col("_dw") > 0, 1.0).otherwise(-1.0)
    return rows.select(*keys, "ts", "ticker", F.when(F.col("_dw") > 0, "BUY").otherwise("SELL").alias("direction"), (trade / F.col("close")).alias("shares"), F.col("close").alias("price"), "slippage_bps", trade_cost(trade, F.col("slippage_bps"), costs).alias("cost_usd"), (F.col("close") * (1 + side * F.col("slippage_bps") / 1e4)).alias("net_price"))


def _mvo(shrink: float, window: int):
    import numpy as np

    def run(pdf):
        wide = pdf.pivot(index="ts", columns="ticker", values="returns").sort_index()
        base = pdf.pivot(index="ts", columns="ticker", values="base").sort_index().fillna(0.0)
        r, w = wide.to_numpy(float), base.to_numpy(float).copy()
        for t in range(len(r)):
            past = r[max(0, t - window) : t]
            ok = np.flatnonzero(np.isnan(past).mean(axis=0) < 0.3) if len(past) > 2 else []
            if len(ok) < 3:
                continue
            x = past[:, ok]
            x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
            s = np.cov(x, rowvar=False)
            s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + 1e-8 * np.eye(len(ok))
            try:
                raw = np.linalg.solve(s, w[t, ok])
            except np.linalg.LinAlgError:
                continue
            total = np.abs(raw).sum()
            if total > 0:
                w[t] = 0
                w[t, ok] = raw / total
        out = base.copy()
        out[:] = w
        return out.reset_index().melt("ts", var_name="ticker", value_name="weight")

    return run


def mvo(df: DataFrame, shrink: float = 0.2, window: int = 60, keys=("alpha_id",), rows_a_task: int = 250) -> DataFrame:
    """Mean-variance weights from the trailing covariance, the current row apart. Takes keys, ts, ticker, returns and signal.

    The dates of a key are dealt into chunks of rows_a_task, each with the `window` dates before it, so a task holds a few hundred dates of one key.
    """
    base = signal_weighted(df, keys).select(*keys, "ts", "ticker", "returns", F.col("weight").alias("base"))
    axis = base.select(*keys, "ts").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    chunk = F.floor(F.col("_i") / rows_a_task)
    ahead = F.floor((F.col("_i") + window) / rows_a_task)
    dealt = base.join(axis, [*keys, "ts"]).withColumn("_own", chunk).withColumn("_chunk", F.explode(F.sequence(chunk, ahead)))

    def run(key, pdf):
        own = pdf.loc[pdf["_own"] == pdf["_chunk"], "ts"].unique()
        out = _mvo(shrink, window)(pdf)
        return out[out["ts"].isin(own)].assign(**dict(zip(keys, key, strict=False)))[[*keys, "ts", "ticker", "weight"]]

    named = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    return dealt.groupBy(*keys, "_chunk").applyInPandas(run, f"{named}, ts timestamp, ticker string, weight double")
