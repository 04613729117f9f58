"""Alpha ledger, IC history, lifecycle and monitoring, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The states of an alpha and the changes that are allowed.
TRANSITIONS = {
    "candidate": ("validated", "retired"),
    "validated": ("paper", "retired"),
    "paper": ("active", "retired"),
    "active": ("decaying", "superseded", "retired"),
    "decaying": ("active", "retired"),
    "retired": (),
    "superseded": (),
}
TERMINAL = tuple(k for k, v in TRANSITIONS.items() if not v)


def query_ledger(ledger: DataFrame, min_sharpe: float | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    if min_sharpe is not None:
        ledger = ledger.where(F.col("sharpe") >= min_sharpe)
    if status is not None:
        ledger = ledger.where(F.col("status") == status)
    return ledger.orderBy(F.col("sharpe").desc(), "alpha_id").limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and new rows, of each key the one of greatest order."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return old.unionByName(new).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def ic_history(history: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows of each alpha."""
    w = Window.partitionBy("alpha_id").orderBy(F.col("date").desc())
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def decay_alerts(history: DataFrame, streak: int = 10, window: int = 20, floor: float = -0.01) -> DataFrame:
    """Per alpha with `window` days or more: its trailing run of negative IC and its mean over the last `window` days, and whether either calls for an alert."""
    newest = Window.partitionBy("alpha_id").orderBy(F.col("date").desc())
    rows = history.withColumns({"_rn": F.row_number().over(newest), "_good": F.sum(F.when(F.col("realized_ic") < 0, 0).otherwise(1)).over(newest)})
    out = rows.groupBy("alpha_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_good") == 0).alias("negative_run"), F.avg(F.when(F.col("_rn") <= window, F.col("realized_ic"))).alias("recent_ic"))
    return out.where(F.col("n") >= window).withColumn("alert", (F.col("negative_run") >= streak) | (F.col("recent_ic") < floor))


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """changes (alpha_id, at, status): those that the lifecycle does not allow. Staying in a state is allowed."""
    before = F.lag("status").over(Window.partitionBy("alpha_id").orderBy("at"))
    rows = changes.withColumn("before", before).where("before IS NOT NULL AND before <> status")
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return rows.where(~F.coalesce(F.array_contains(allowed[F.col("before")], F.col("status")), F.lit(False)))


def dashboard(ledger: DataFrame, history: DataFrame) -> DataFrame:
    """Alphas that are in no terminal state, with their mean IC of 20 days, best Sharpe first."""
    recent = ic_history(history).groupBy("alpha_id").agg(F.avg("realized_ic").alias("ic20"))
    return ledger.where(~F.col("status").isin(*TERMINAL)).join(recent, "alpha_id", "left").orderBy(F.col("sharpe").desc(), "alpha_id")
