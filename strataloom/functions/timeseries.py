"""Time-series operators as Columns over a ticker's rows. A null in the window makes the result null, unless min_periods is given."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _full(w: int, spec: WindowSpec, xs: tuple[Column, ...], value: Column, min_periods: int | None = None) -> Column:
    frame = spec.rowsBetween(-(w - 1), 0)
    if len(xs) == 1:
        ok = F.count(xs[0]).over(frame) >= (min_periods or w)
    else:
        ok = F.count(F.when(xs[0].isNotNull() & xs[1].isNotNull(), 1)).over(frame) >= (min_periods or w)
    return F.when(ok, value)


def _agg(function):
    def op(x: Column, w: int, spec: WindowSpec, min_periods: int | None = None) -> Column:
        return _full(w, spec, (x,), function(x).over(spec.rowsBetween(-(w - 1), 0)), min_periods)

    return op


ts_mean, ts_std, ts_var, ts_sum, ts_max, ts_min = map(_agg, (F.avg, F.stddev_samp, F.var_samp, F.sum, F.max, F.min))


def _values(x: Column, w: int, spec: WindowSpec) -> Column:
    return F.collect_list(x).over(spec.rowsBetween(-(w - 1), 0))


def ts_rank(x, w, spec):
    """Share of the window that is at most the last value."""
    return _full(w, spec, (x,), F.size(F.filter(_values(x, w, spec), lambda v: v <= x)) / F.lit(float(w)))


def ts_decay_linear(x, w, spec):
    """Linear weights, the newest w. Short windows are a sum of lags, long ones fold the list."""
    if w <= 16:
        total = sum((F.lag(x, k).over(spec) * float(w - k) for k in range(1, w)), x * float(w))
        return total / F.lit(w * (w + 1) / 2.0)
    weights = F.transform(F.sequence(F.lit(1), F.lit(w)), lambda i: i.cast("double"))
    folded = F.aggregate(F.zip_with(_values(x, w, spec), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return _full(w, spec, (x,), folded / F.lit(w * (w + 1) / 2.0))


def ts_delay(x, w, spec):
    return F.lag(x, w).over(spec)


def ts_delta(x, w, spec):
    return x - F.lag(x, w).over(spec)


def ts_momentum_decay(x, w, spec):
    return F.lag(x, 1).over(spec) - F.lag(x, w + 1).over(spec)


def _arg(best):
    def op(x, w, spec):
        v = _values(x, w, spec)
        return _full(w, spec, (x,), (F.array_position(v, best(v)) - 1).cast("double") / float(max(w - 1, 1)))

    return op


ts_argmax, ts_argmin = _arg(F.array_max), _arg(F.array_min)


def ts_zscore(x, w, spec):
    sd = ts_std(x, w, spec)
    return F.when(sd != 0, (x - ts_mean(x, w, spec)) / sd)


def ts_skew(x, w, spec):
    if w < 3:
        return F.lit(None).cast("double")
    raw = F.skewness(x).over(spec.rowsBetween(-(w - 1), 0))
    value = F.when(~F.isnan(raw), raw * (math.sqrt(w * (w - 1)) / (w - 2)))
    return _full(w, spec, (x,), value)


def ts_kurt(x, w, spec):
    if w < 4:
        return F.lit(None).cast("double")
    raw = F.kurtosis(x).over(spec.rowsBetween(-(w - 1), 0))
    return _full(w, spec, (x,), F.when(~F.isnan(raw), (raw + 3) * ((w - 1) / w) ** 2 - 3))


def ts_entropy(x, w, spec, bins: int = 10):
    """Entropy of the window over equal-width bins, as a share of ln(bins); 0 for a constant window."""
    v = _values(x, w, spec)
    low, high = F.array_min(v), F.array_max(v)
    bin_of = F.transform(v, lambda a: F.least(F.lit(bins - 1), F.floor((a - low) / ((high - low) / bins))))
    share = lambda k: F.size(F.filter(bin_of, lambda b: b == k)) / F.lit(float(w))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda acc, k: acc - F.when(share(k) > 0, share(k) * F.ln(share(k))).otherwise(0.0))
    return _full(w, spec, (x,), F.when(high > low, total / math.log(bins)).otherwise(0.0))


def rolling_corr(x, y, frame):
    """Correlation over a frame; null where a side is flat or has one row (corr itself raises there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)
    return F.when(spread > 1e-12, F.try_divide(F.covar_samp(a, b).over(frame), spread))


def ts_corr(x, y, w, spec, exact: bool = False):
    """Correlation scaled by (w - 1) / w, the population covariance over sample deviations; exact gives the plain one."""
    return _full(w, spec, (x, y), rolling_corr(x, y, spec.rowsBetween(-(w - 1), 0)) * (1.0 if exact else (w - 1) / w))


def ts_cov(x, y, w, spec):
    if w < 2:
        return F.lit(None).cast("double")
    return _full(w, spec, (x, y), F.covar_samp(x, y).over(spec.rowsBetween(-(w - 1), 0)))


OPS = {n: f for n, f in globals().items() if n.startswith("ts_")}
