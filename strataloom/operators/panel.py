"""Panel preparation: schema, shape, calendar, universe, derived fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("open", "high", "low", "close", "volume", "vwap", "adj_factor")


def by_ticker():
    """Window over a ticker's rows in order."""
    return Window.partitionBy("ticker").orderBy("ts")


class SchemaError(ValueError):
    pass


def enforce_schema(df: DataFrame, keep_extra: bool = False, order_col: str | None = None) -> DataFrame:
    """Trimmed lower-case names, ts and ticker, doubles (what does not parse, and NaN, is null; adj_factor is adj_close / close where a vendor gives that, else 1), the last row of a key by order_col (without one, by a hash of the row, so that the choice does not depend on partitions), upper-case tickers."""
    names = [c.strip().lower() for c in df.columns]
    df = df.toDF(*names)
    if "timestamp" in names and "ts" not in names:
        df = df.withColumnRenamed("timestamp", "ts")
    missing = {"ts", "ticker"} - set(df.columns)
    if missing:
        raise SchemaError(f"missing {sorted(missing)}")

    if "adj_close" in names and "adj_factor" not in names:
        df = df.withColumn("adj_factor", F.try_divide(F.expr("try_cast(adj_close AS double)"), F.expr("try_cast(close AS double)")))

    def clean(c: str) -> Column:
        if c not in df.columns:
            return F.lit(1.0 if c == "adj_factor" else None).cast("double").alias(c)
        x = F.expr(f"try_cast(`{c}` AS double)")
        return F.when(~F.isnan(x), x).alias(c)

    extra = [c for c in df.columns if keep_extra and c not in (*NUMERIC, "ts", "ticker")]
    order = F.col(order_col) if order_col else F.xxhash64(*(F.col(c).cast("string") for c in df.columns))
    out = df.select(F.date_trunc("day", F.expr("try_cast(ts AS timestamp)")).alias("ts"), F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"), *map(clean, NUMERIC), *extra, order.alias("_order"))
    last = Window.partitionBy("ts", "ticker").orderBy(F.col("_order").desc())
    return out.where("ts IS NOT NULL AND ticker IS NOT NULL").withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_order")


def melt(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.unpivot(["ts", "ticker"], fields, "field", "value")


def pivot(df: DataFrame, field: str, tickers: list[str]) -> DataFrame:
    """For export only: a column for each ticker."""
    return df.groupBy("ts").pivot("ticker", tickers).agg(F.last(field, ignorenulls=True))


def densify(bars: DataFrame) -> DataFrame:
    """A row for each observed ts and each ticker. The axis and the ticker list are the small side of a product whose size is the result's."""
    axis = bars.select("ts").distinct()
    tickers = bars.select("ticker", "sector").distinct()
    return axis.crossJoin(tickers).join(bars.drop("sector"), ["ts", "ticker"], "left")


def business_days(bars: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each weekday of a calendar range and each ticker."""
    days = bars.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")).where("weekday(d) < 5").select(F.col("d").cast("timestamp").alias("ts"))
    return days.crossJoin(bars.select("ticker").distinct()).join(bars, ["ts", "ticker"], "left")


def ffill(df: DataFrame, fields: list[str], limit: int = 5) -> DataFrame:
    """Fills up to `limit` rows in a row from the last value."""
    frame = by_ticker().rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in fields})


def adjust(df: DataFrame) -> DataFrame:
    factor = F.coalesce("adj_factor", F.lit(1.0))
    return df.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")} | {"adj_close": F.col("close") * factor})


def derived(df: DataFrame) -> DataFrame:
    """returns (log), simple_returns and, where the whole column is null, vwap = (high + low + close) / 3."""
    before = F.lag("close").over(by_ticker())
    df = df.withColumns({"returns": F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)), "simple_returns": F.when(before != 0, F.col("close") / before - 1)})
    if "vwap" not in df.columns:
        return df.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    none = df.agg((F.count("vwap") == 0).alias("_none"))
    return df.crossJoin(F.broadcast(none)).withColumn("vwap", F.when(F.col("_none"), (F.col("high") + F.col("low") + F.col("close")) / 3).otherwise(F.col("vwap"))).drop("_none")


def coverage_filter(df: DataFrame, least: float = 0.95) -> DataFrame:
    """Tickers whose share of rows with a close is at least `least`."""
    good = df.groupBy("ticker").agg((F.count("close") / F.count(F.lit(1))).alias("share")).where(F.col("share") >= least).select("ticker")
    return df.join(good, "ticker", "left_semi")


def universe_asof(df: DataFrame, history: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Rows of the tickers that the latest entry of history (date, ticker, active) up to as_of marks active; unknown tickers stay unless strict. An empty history keeps all, or none if strict."""
    known = history.where(F.col("date") <= F.lit(as_of).cast("timestamp")).groupBy("ticker").agg(F.max_by("active", "date").alias("active"))
    if strict:
        return df.join(known.where("active"), "ticker", "left_semi")
    return df.join(known.where("NOT active"), "ticker", "left_anti")


def universe_ranges(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows between a ticker's ipo and delist (null: open) dates."""
    return df.join(ranges, "ticker").where((F.col("ts") >= F.col("ipo")) & (F.col("delist").isNull() | (F.col("ts") <= F.col("delist")))).drop("ipo", "delist")


def null_report(df: DataFrame, fields: list[str]) -> DataFrame:
    return melt(df, fields).groupBy("ticker", "field").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.round(100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1)), 2).alias("pct")).where("nulls > 0")


def describe(df: DataFrame, fields: list[str]) -> DataFrame:
    return melt(df, fields).groupBy("field").agg(F.countDistinct("ts").alias("n_ts"), F.countDistinct("ticker").alias("n_tickers"), F.round(100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1)), 4).alias("null_pct"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """sectors (ticker, sector), a dimension of a row a ticker; unknown tickers get -1."""
    return df.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(-1)))


FILLED = ["open", "high", "low", "close", "volume", "vwap"]


def standard_panel(bars: DataFrame, limit: int = 5) -> DataFrame:
    """Dense, filled (at most `limit` rows), with derived returns: what the other operators take."""
    return derived(ffill(densify(bars), FILLED, limit))
