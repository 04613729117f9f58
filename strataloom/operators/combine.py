"""Combining signals, the alpha pool, and market regimes. Signals are long: (alpha_id, ts, ticker, signal)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winsorized(df: DataFrame, k: float = 3.0) -> DataFrame:
    """To k population deviations per alpha and ts."""
    w = Window.partitionBy("alpha_id", "ts")
    mean, sd, s = F.avg("signal").over(w), F.stddev_pop("signal").over(w), F.col("signal")
    return df.withColumn("signal", F.when(s.isNotNull(), F.least(F.greatest(s, mean - k * sd), mean + k * sd)))


def combine(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight times signal per (ts, ticker), nulls skipped (0 if all are null). weights: one per alpha, a handful."""
    total = sum(abs(w) for w in weights.values())
    if not total:
        raise ValueError("all weights are 0")
    table = F.create_map(*(F.lit(x) for k, w in sorted(weights.items()) for x in (k, w / total)))
    return winsorized(df).groupBy("ts", "ticker").agg(F.coalesce(F.sum(table[F.col("alpha_id")] * F.col("signal")), F.lit(0.0)).alias("signal"))


def equal_weights(ids: list[str]) -> dict[str, float]:
    return {i: 1 / len(ids) for i in ids}


def ic_weights(ics: dict[str, float]) -> dict[str, float]:
    """Mean IC, not below 0; equal if none is above."""
    w = {k: max(v or 0.0, 0.0) for k, v in ics.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total else equal_weights(list(ics))


def min_variance_weights(series: DataFrame, ids: list[str]) -> dict[str, float]:
    """Long-only minimum variance of the alphas' daily returns (alpha_id, ts, r): the covariances are aggregated, the small inverse is taken on the driver."""
    import numpy as np

    wide = series.groupBy("ts").pivot("alpha_id", ids).agg(F.first("r"))
    row = wide.agg(*(F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{i}_{j}") for i, a in enumerate(ids) for j, b in enumerate(ids))).first()
    cov = np.array([[row[f"c{i}_{j}"] or 0.0 for j in range(len(ids))] for i in range(len(ids))]) + 1e-6 * np.eye(len(ids))
    w = np.maximum(np.linalg.solve(cov, np.ones(len(ids))), 0)
    return dict(zip(ids, (w / w.sum()).tolist() if w.sum() > 0 else [1 / len(ids)] * len(ids), strict=True))


def fingerprint(df: DataFrame) -> DataFrame:
    """Mean signal per alpha and ts."""
    return df.groupBy("alpha_id", "ts").agg(F.avg("signal").alias("level"))


def pairwise_corr(prints: DataFrame, least: int = 10) -> DataFrame:
    """Correlation of the fingerprints of each pair of pool members (a pool is bounded by its max_size) with `least` common points."""
    a, b = (prints.select(F.col("alpha_id").alias(f"{x}_id"), "ts", F.col("level").alias(x)) for x in "ab")
    return a.join(b, "ts").where("a_id < b_id AND a IS NOT NULL AND b IS NOT NULL").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("corr")).where(F.col("n") >= least)


class AlphaPool:
    """Accepts alphas in order: none twice, none whose |correlation| with a member reaches the threshold; the least fit go when it is over max_size."""

    def __init__(self, max_size: int = 50, threshold: float = 0.7):
        self.max_size, self.threshold, self.members = max_size, threshold, {}

    @staticmethod
    def _corr(a: list[float | None], b: list[float | None]) -> float | None:
        pairs = [(x, y) for x, y in zip(a, b, strict=False) if x is not None and y is not None and x == x and y == y]
        n = len(pairs)
        if n < 10:
            return None
        mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
        sxy, sxx, syy = (sum(f) for f in zip(*(((x - mx) * (y - my), (x - mx) ** 2, (y - my) ** 2) for x, y in pairs), strict=True))
        return sxy / math.sqrt(sxx * syy) if sxx > 0 and syy > 0 else None

    def add(self, dsl: str, fitness: float, vector: list[float | None]) -> bool:
        if dsl in self.members:
            return False
        if any(abs(c) >= self.threshold for _, v in self.members.values() if (c := self._corr(vector, v)) is not None):
            return False
        self.members[dsl] = (fitness, vector)
        if len(self.members) > self.max_size:
            del self.members[min(self.members, key=lambda k: (self.members[k][0], k))]
        return dsl in self.members

    def top(self, k: int) -> list[tuple[str, float]]:
        return sorted(((d, f) for d, (f, _) in self.members.items()), key=lambda x: (-x[1], x[0]))[:k]

    def diagnostics(self) -> dict:
        f = [x for x, _ in self.members.values()]
        return {"size": len(f), "best": max(f, default=None), "mean": sum(f) / len(f) if f else None}

    def components(self, k: int = 10):
        """Principal components of the members' vectors (k, points); nulls count as the mean."""
        import numpy as np

        x = np.array([[np.nan if v is None else v for v in vec] for _, vec in self.members.values()], float)
        x = x - np.nanmean(x, axis=1, keepdims=True)
        return np.linalg.svd(np.nan_to_num(x), full_matrices=False)[2][: min(k, *x.shape)]


def regimes(series: DataFrame, drift_rows: int = 60, vol_rows: int = 20, drift: float = 0.05, quantile: float = 0.8) -> DataFrame:
    """series (ts, r): bull, bear or sideways by the compounded return of 60 rows, high_vol above the 80 % quantile of 20-row deviations (which goes first); null before the first full windows. One market series: its one partition is small."""
    w = Window.orderBy("ts")
    long, short = w.rowsBetween(-(drift_rows - 1), 0), w.rowsBetween(-(vol_rows - 1), 0)
    rows = series.select("ts", "r", F.when(F.count("r").over(long) >= drift_rows, F.exp(F.sum(F.log1p("r")).over(long)) - 1).alias("drift"), F.when(F.count("r").over(short) >= vol_rows, F.stddev_samp("r").over(short)).alias("vol"))
    cut = rows.agg(F.percentile("vol", F.lit(quantile)).alias("cut"))
    label = F.when(F.col("drift").isNull(), F.lit(None)).when(F.col("vol") > F.col("cut"), "high_vol").when(F.col("drift") > drift, "bull").when(F.col("drift") < -drift, "bear").otherwise("sideways")
    return rows.crossJoin(F.broadcast(cut)).select("ts", "drift", "vol", label.alias("regime"))


def regime_at(labels: DataFrame, dates: DataFrame) -> DataFrame:
    """The last regime at or before each of dates (ts)."""
    both = labels.where("regime IS NOT NULL").select("ts", "regime", F.lit(0).alias("_ask")).unionByName(dates.select("ts", F.lit(None).cast("string").alias("regime"), F.lit(1).alias("_ask")))
    w = Window.orderBy("ts", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("regime", F.last("regime", ignorenulls=True).over(w)).where("_ask = 1").drop("_ask")


#: How much a factor family is favoured in a regime; 1 where nothing is said.
TILTS = {
    "bull": {"momentum": 1.5, "reversion": 0.75, "volatility": 0.75},
    "bear": {"momentum": 0.5, "reversion": 1.25, "volatility": 1.25},
    "sideways": {"momentum": 0.75, "reversion": 1.5},
    "high_vol": {"momentum": 0.5, "reversion": 1.0, "volatility": 1.5},
}


def regime_weights(alphas: list[tuple[str, str, float]], regime: str) -> dict[str, float]:
    """alphas: (id, family, sharpe). max(sharpe, 0) + 0.1, times the family's tilt, normalised."""
    w = {i: (max(s, 0.0) + 0.1) * TILTS.get(regime, {}).get(f, 1.0) for i, f, s in alphas}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}
