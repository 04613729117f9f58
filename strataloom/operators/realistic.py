"""The whole evaluation of expressions on a panel, in and out of sample, as one plan keyed by (alpha_id, segment). Reports are on net returns: after commission, slippage and borrowing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import signals
from ..sources.store import materialise
from . import backtest, metrics, portfolio, validation
from .signal import SignalConfig, process

KEYS = ("alpha_id", "segment")
KEEP = ("ts", "ticker", "sector", "close", "volume", "returns")


def construct(rows: DataFrame, config: SignalConfig = SignalConfig(), costs: portfolio.Costs = portfolio.Costs()) -> DataFrame:
    """Weights of processed signals (alpha_id, segment, ts, ticker, signal, returns, ...) by config.mode, capped, market neutral and within the traded volume. Rows before a key's first signal are left out."""
    first = F.min(F.when(F.col("signal").isNotNull(), F.col("ts"))).over(Window.partitionBy(*KEYS))
    rows = rows.withColumn("_first", first).where("ts >= _first").drop("_first")
    if config.mode == "decile":
        rows = portfolio.decile(rows, config.top, keys=KEYS)
    elif config.mode == "mvo":
        rows = rows.join(portfolio.mvo(rows, keys=KEYS), [*KEYS, "ts", "ticker"])
    else:
        rows = portfolio.signal_weighted(rows, KEYS)
    if config.max_weight:
        rows = portfolio.cap_weight(rows, config.max_weight, KEYS)
    return portfolio.cap_adv(portfolio.with_adv(portfolio.market_neutral(rows, KEYS), keys=KEYS), costs, KEYS)


def weights(panel: DataFrame, expressions: dict[str, str], config: SignalConfig = SignalConfig(), costs: portfolio.Costs = portfolio.Costs()) -> DataFrame:
    """panel has a segment column. Windows of signals do not reach over a segment's start, as in a run that sees only that segment."""
    wide = signals(panel, expressions, keys=("segment",), keep=KEEP)
    return construct(process(wide.unpivot(["segment", *KEEP], list(expressions), "alpha_id", "signal"), config, KEYS), config, costs)


def results(w: DataFrame, costs: portfolio.Costs = portfolio.Costs()) -> tuple[DataFrame, DataFrame]:
    """(legs, daily): the held weights, and per ts gross, net, equity, cost, long, short, turnover and the equal-weighted market (bench); both made once."""
    legs = materialise(backtest.legs(w, KEYS))
    market = legs.groupBy(*KEYS, "ts").agg(F.avg("change").alias("bench"))
    day = backtest.daily(legs, KEYS, costs).join(backtest.equity_curve(legs, KEYS, costs).drop("gross"), [*KEYS, "ts"]).join(market, [*KEYS, "ts"])
    return legs, materialise(day)


def risk_report(legs: DataFrame, day: DataFrame, n_trials: int = 1) -> DataFrame:
    """One row an alpha and segment: return, risk, drawdown, Calmar, turnover, IC, legs, benchmark, deflated Sharpe and the longest losing streak, on net returns. What cannot be told is null."""
    series, keys = day.select(*KEYS, "ts", F.col("net").alias("r"), "bench"), list(KEYS)
    legged = metrics.leg_analysis(day, KEYS).groupBy(*KEYS)
    side = [F.max(F.when(F.col("leg") == x, F.col(c))).alias(f"{x}_{c}") for x in ("long", "short") for c in ("ann_return", "sharpe")]
    parts = [
        metrics.max_drawdown(series, KEYS).select(*keys, "mdd", F.col("peak").alias("mdd_start"), F.col("trough").alias("mdd_end"), F.col("days").alias("mdd_days")),
        metrics.turnover_analysis(day, KEYS),
        metrics.ic_ir(metrics.rank_ic(legs, KEYS), KEYS).select(*keys, "ic_mean", "ic_ir"),
        legged.agg(*side),
        metrics.benchmark_stats(series, KEYS),
        metrics.portfolio_beta(series.where("r IS NOT NULL AND bench IS NOT NULL"), KEYS).withColumnRenamed("beta", "portfolio_beta"),
        metrics.deflated_sharpes(series, n_trials, KEYS),
        metrics.losing_streak(series, KEYS),
    ]
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts, metrics.summary(series, KEYS))
    return out.withColumn("calmar", metrics.calmar(F.col("ann_return"), F.col("mdd")))


def overfitting(report: DataFrame) -> DataFrame:
    """One row an alpha: Sharpe in and out of sample, the share of it that is lost, and whether that is more than half."""
    wide = report.groupBy("alpha_id").pivot("segment", ["IS", "OOS"]).agg(F.first("sharpe"))
    gap = F.try_divide(F.col("IS") - F.col("OOS"), F.abs("IS"))
    return wide.select("alpha_id", F.col("IS").alias("sharpe_is"), F.col("OOS").alias("sharpe_oos"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), gap)).alias("overfit")).withColumn("flagged", F.col("overfit") > 0.5)


def run(panel: DataFrame, expressions: dict[str, str], config: SignalConfig = SignalConfig(), costs: portfolio.Costs = portfolio.Costs(), oos: float = 0.3, embargo: int = 20) -> dict[str, DataFrame]:
    """daily, report (risk_report), overfit (one row an alpha), stress (worst periods and crises), deciles, rolling (Sharpe of 60 days, mean IC of 20)."""
    validation.check_panel(panel)
    split = validation.with_segment(panel, oos, embargo).where("segment <> 'EMBARGO'")
    legs, day = results(weights(split, expressions, config, costs), costs)
    series = day.select(*KEYS, "ts", F.col("net").alias("r"))
    report = materialise(risk_report(legs, day, len(expressions)))
    worst = metrics.worst_periods(series, KEYS).select(*KEYS, F.col("period").alias("name"), "r")
    crises = metrics.crisis_windows(series, keys=KEYS).select(*KEYS, F.col("crisis").alias("name"), "r")
    ic = metrics.rolling_ic(metrics.rank_ic(legs, KEYS), KEYS).select(*KEYS, "ts", "rolling_ic")
    rolling = metrics.rolling_sharpe(series, KEYS).select(*KEYS, "ts", "sharpe").join(ic, [*KEYS, "ts"], "left")
    return {"daily": day, "report": report, "overfit": overfitting(report), "stress": worst.unionByName(crises), "deciles": metrics.decile_returns(legs, keys=KEYS), "rolling": rolling}


def walk_forward(panel: DataFrame, expression: str, config: SignalConfig = SignalConfig(), k: int = 5, min_train: int = 120, embargo: int = 20) -> dict[str, DataFrame]:
    """One plan over all folds: the segment of a row is its fold and part."""
    n = panel.select("ts").distinct().count()
    if not validation.folds(n, k, min_train, embargo):
        raise ValueError(f"{n} dates hold no {k} folds after {min_train} training dates and an embargo of {embargo}")
    rows = validation.with_folds(panel, k, min_train, embargo).withColumn("segment", F.concat_ws(":", "fold", "segment"))
    legs = backtest.legs(weights(rows, {"alpha": expression}, config), KEYS)
    per = metrics.summary(backtest.equity_curve(legs, KEYS).select(*KEYS, "ts", F.col("net").alias("r")), KEYS)
    per = materialise(per.select(F.substring_index("segment", ":", 1).cast("int").alias("fold"), F.substring_index("segment", ":", -1).alias("segment"), "sharpe"))
    return {"folds": per, "summary": validation.fold_summary(per)}
