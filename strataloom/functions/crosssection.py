"""Cross-sectional and group operators as Columns over the rows of one ts (and group). Nulls are skipped and stay null."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def rank(x: Column, spec: WindowSpec) -> Column:
    """Average rank from 0 to 1 among the values that are not null."""
    n = F.count(x).over(spec)
    below = F.rank().over(spec.orderBy(x.asc_nulls_last())) - 1
    # rows of equal value: those up to this value, less those below
    upto = F.count(x).over(spec.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (below + (upto - below - 1) / 2) / F.greatest(n - 1, F.lit(1)))


def zscore(x, spec):
    sd = F.stddev_samp(x).over(spec)
    return F.when(sd != 0, (x - F.avg(x).over(spec)) / sd)


def scale(x, spec):
    total = F.sum(F.abs(x)).over(spec)
    return F.when(total != 0, x / total)


def demean(x, spec):
    return x - F.avg(x).over(spec)


def winsorize(x, spec, k: float = 3.0):
    mean, sd = F.avg(x).over(spec), F.stddev_samp(x).over(spec)
    return F.when(x.isNotNull() & sd.isNotNull(), F.least(F.greatest(x, mean - k * sd), mean + k * sd))


def normalize(x, spec):
    low, high = F.min(x).over(spec), F.max(x).over(spec)
    return F.when(high != low, (x - low) / (high - low))


def group_mean(x, spec):
    """Of the group, also for members whose own value is null."""
    return F.avg(x).over(spec)
