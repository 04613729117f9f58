"""Queries of the panel engine and their SQL. Numbers are rounded to DP places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, panel, quality
from .plans.compiler import signals
from .sources import bars as source
from .sources.store import materialise

DP = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, dp: int = DP) -> DataFrame:
    return df.select(*(F.round(c, dp).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_round(*columns: str, dp: int = DP) -> str:
    return ", ".join(f"round({c.partition(' AS ')[0]}, {dp}) AS {c.rpartition(' AS ')[2]}" for c in columns)


def _bars_sql(rows: str) -> str:
    return f"""
WITH rows AS ({rows}),
bars AS (SELECT ts, ticker, sector, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(q) AS volume, sum(e) / sum(q) AS vwap, 1.0::DOUBLE AS adj_factor FROM rows GROUP BY ts, ticker, sector)"""


_KEY = "row(l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS k, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice AS e"
BARS_SQL = {
    "nation_week": _bars_sql(f"SELECT date_trunc('week', l_shipdate) AS ts, n_name AS ticker, n_regionkey AS sector, {_KEY} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"),
    "brand_week": _bars_sql(f"SELECT date_trunc('week', l_shipdate) AS ts, p_brand AS ticker, regexp_extract(p_brand, '([0-9]+)', 1)::INT % 5 AS sector, {_KEY} FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "supp_month": _bars_sql(f"SELECT date_trunc('month', l_shipdate) AS ts, l_suppkey::VARCHAR AS ticker, s_nationkey AS sector, {_KEY} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
}
_OHLCV = ("open", "high", "low", "close", "volume", "vwap")
DENSE_SQL = f"""{BARS_SQL["nation_week"]},
dense AS (SELECT a.ts, t.ticker, t.sector, open, high, low, close, volume, vwap, adj_factor FROM (SELECT DISTINCT ts FROM bars) a CROSS JOIN (SELECT DISTINCT ticker, sector FROM bars) t LEFT JOIN bars b ON b.ts = a.ts AND b.ticker = t.ticker)"""
PANEL_SQL = f"""{DENSE_SQL},
filled AS (SELECT ts, ticker, sector, adj_factor, {", ".join(f"last_value({c} IGNORE NULLS) OVER f AS {c}" for c in _OHLCV)} FROM dense WINDOW f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
panel AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER t > 0 THEN ln(close / lag(close) OVER t) END AS returns, CASE WHEN lag(close) OVER t <> 0 THEN close / lag(close) OVER t - 1 END AS simple_returns FROM filled WINDOW t AS (PARTITION BY ticker ORDER BY ts))"""


def bars(spark, sf_dir):
    return source.nation_week(spark, sf_dir)


def std(spark, sf_dir):
    """The standard panel, made once per session and folder: what every panel query reads."""
    return source.once(spark, ("standard_panel", sf_dir), lambda: materialise(panel.standard_panel(bars(spark, sf_dir))))


# --- sources and panel preparation ---------------------------------------------------------------

for _name, _load in (("nation_week", source.nation_week), ("brand_week", source.brand_week), ("supp_month", source.supp_month)):
    query(f"bars_{_name}", f"{BARS_SQL[_name]} SELECT ts, ticker, sector, {sql_round(*_OHLCV, 'adj_factor')} FROM bars")(lambda s, d, f=_load: rounded(f(s, d)))

query("bars_events", "SELECT date_trunc('day', ts) AS ts, user_id::VARCHAR AS ticker, round(arg_min(value, row(ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, row(ts, event_id)), 6) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL")(lambda s, d: rounded(source.event_bars(s, d)))
query("multi_dataset_union", f"SELECT dataset, count(*) AS n, count(DISTINCT ticker) AS tickers, min(ts) AS first_ts FROM ((SELECT 'nation_week' AS dataset, ticker, ts FROM ({BARS_SQL['nation_week']} SELECT * FROM bars)) UNION ALL (SELECT 'brand_week', ticker, ts FROM ({BARS_SQL['brand_week']} SELECT * FROM bars))) GROUP BY dataset")(
    lambda s, d: source.load_many(s, d, ["nation_week", "brand_week"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("ts").alias("first_ts"))
)
query("densify_left", f"{DENSE_SQL} SELECT ts, ticker, sector, {sql_round('close', 'volume')} FROM dense")(lambda s, d: rounded(panel.densify(bars(s, d)).select("ts", "ticker", "sector", "close", "volume")))
query("ffill_limit5", f"{PANEL_SQL} SELECT ts, ticker, {sql_round('close', 'volume')} FROM filled")(lambda s, d: rounded(panel.ffill(panel.densify(bars(s, d)), ["close", "volume"]).select("ts", "ticker", "close", "volume")))
query("derived_returns", f"{PANEL_SQL} SELECT ts, ticker, {sql_round('returns', 'simple_returns', 'vwap')} FROM panel")(lambda s, d: rounded(std(s, d).select("ts", "ticker", "returns", "simple_returns", "vwap")))
query("adjust_ohlc", f"{BARS_SQL['nation_week']} SELECT ts, ticker, {sql_round(*(f'{c} * f AS {c}' for c in _OHLCV[:4]), 'close * f AS adj_close')} FROM (SELECT *, CASE WHEN sector = 1 THEN 1.2 ELSE 1.0 END::DOUBLE AS f FROM bars)")(
    lambda s, d: rounded(panel.adjust(bars(s, d).withColumn("adj_factor", F.when(F.col("sector") == 1, F.lit(1.2)))).select("ts", "ticker", "open", "high", "low", "close", "adj_close"))
)
query("coverage_filter", f"{DENSE_SQL} SELECT ts, ticker, round(close, 6) AS close FROM dense WHERE ticker IN (SELECT ticker FROM dense GROUP BY ticker HAVING count(close) / count(*) >= 0.975)")(lambda s, d: rounded(panel.coverage_filter(panel.densify(bars(s, d)), 0.975).select("ts", "ticker", "close")))


def _history(s, d):
    return bars(s, d).select(F.col("ts").alias("date"), "ticker", (F.col("volume") >= 100).alias("active"))


for _strict in (False, True):
    query(
        f"pit_universe_{'strict' if _strict else 'asof'}",
        f"{BARS_SQL['nation_week']}, latest AS (SELECT ticker, arg_max(volume >= 100, ts) AS active FROM bars WHERE ts <= TIMESTAMP '1998-06-01' GROUP BY ticker) SELECT ts, ticker, round(close, 6) AS close FROM bars WHERE ticker {'IN (SELECT ticker FROM latest WHERE active)' if _strict else 'NOT IN (SELECT ticker FROM latest WHERE NOT active)'}",
    )(lambda s, d, strict=_strict: rounded(panel.universe_asof(bars(s, d), _history(s, d), "1998-06-01", strict).select("ts", "ticker", "close")))


def _ranges(s, d):
    return bars(s, d).groupBy("ticker").agg(F.min("ts").alias("ipo"), F.when(F.max("sector") == 2, F.to_timestamp(F.lit("1999-01-01"))).alias("delist"))


query("universe_ranges", f"{BARS_SQL['nation_week']} SELECT ts, ticker FROM bars WHERE sector <> 2 OR ts <= TIMESTAMP '1999-01-01'")(lambda s, d: panel.universe_ranges(bars(s, d), _ranges(s, d)).select("ts", "ticker"))
query("null_report", f"{DENSE_SQL} SELECT ticker, field, count(*) FILTER (value IS NULL) AS nulls, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 2) AS pct FROM (SELECT ticker, 'close' AS field, close AS value FROM dense UNION ALL SELECT ticker, 'volume', volume FROM dense) GROUP BY ticker, field HAVING count(*) FILTER (value IS NULL) > 0")(lambda s, d: panel.null_report(panel.densify(bars(s, d)), ["close", "volume"]))
query("describe_fields", f"{DENSE_SQL} SELECT field, count(DISTINCT ts) AS n_ts, count(DISTINCT ticker) AS n_tickers, round(100.0 * count(*) FILTER (value IS NULL) / count(*), 4) AS null_pct, min(ts) AS start_ts, max(ts) AS end_ts FROM (SELECT ts, ticker, 'close' AS field, close AS value FROM dense UNION ALL SELECT ts, ticker, 'volume', volume FROM dense) GROUP BY field")(lambda s, d: panel.describe(panel.densify(bars(s, d)), ["close", "volume"]))
query("melt_long", f"{BARS_SQL['nation_week']} SELECT ts, ticker, 'close' AS field, round(close, 6) AS value FROM bars UNION ALL SELECT ts, ticker, 'volume', round(volume, 6) FROM bars")(lambda s, d: rounded(panel.melt(bars(s, d), ["close", "volume"])))
_NATIONS = [f"NATION_{i}" for i in range(25)]
query("pivot_wide", f"{BARS_SQL['nation_week']} SELECT ts, {', '.join(f'round(max(close) FILTER (ticker = {chr(39)}{n}{chr(39)}), 6) AS {n}' for n in _NATIONS)} FROM bars GROUP BY ts")(lambda s, d: rounded(panel.pivot(bars(s, d), "close", _NATIONS)))
query("sector_lookup", f"{BARS_SQL['nation_week']} SELECT ts, ticker, CASE WHEN sector < 3 THEN sector ELSE -1 END AS sector FROM bars")(lambda s, d: panel.with_sector(bars(s, d).drop("sector"), bars(s, d).where("sector < 3").select("ticker", "sector").distinct()).select("ts", "ticker", "sector"))
query("business_day_index", "WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2022-01-03', TIMESTAMP '2022-12-30', INTERVAL 1 DAY)) AS ts) SELECT ts, n_name AS ticker FROM d CROSS JOIN nation WHERE isodow(ts) < 6")(
    lambda s, d: panel.business_days(source.read(s, d, "nation").select(F.lit(None).cast("timestamp").alias("ts"), F.col("n_name").alias("ticker")), "2022-01-03", "2022-12-30").select("ts", "ticker")
)
query("enforce_schema", "SELECT DISTINCT date_trunc('day', o_orderdate) AS ts, upper(trim(o_orderstatus)) AS ticker, round(arg_max(o_totalprice, o_orderkey), 6) AS close, 1.0::DOUBLE AS adj_factor FROM orders GROUP BY 1, 2")(
    lambda s, d: rounded(panel.enforce_schema(source.read(s, d, "orders").select(F.col("o_orderdate").alias(" Timestamp "), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("TICKER"), F.col("o_totalprice").cast("string").alias("Close"), "o_orderkey"), order_col="o_orderkey").select("ts", "ticker", "close", "adj_factor"))
)
query("panel_metadata", f"{BARS_SQL['nation_week']} SELECT min(ts) AS start_ts, max(ts) AS end_ts, count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows FROM bars")(lambda s, d: __import__("strataloom.sources.store", fromlist=["metadata"]).metadata(bars(s, d)))

# --- quality and filters -------------------------------------------------------------------------

query("gaps_islands", f"{DENSE_SQL}, g AS (SELECT ticker, ts, close IS NULL AS gap, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS rn FROM dense) SELECT ticker, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length FROM (SELECT *, rn - row_number() OVER (PARTITION BY ticker ORDER BY ts) AS island FROM g WHERE gap) GROUP BY ticker, island")(lambda s, d: quality.gaps(panel.densify(bars(s, d))))
query("spikes", f"{DENSE_SQL} SELECT ts, ticker, round(change, 6) AS change FROM (SELECT ts, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS change FROM dense) WHERE abs(change) > 0.5")(lambda s, d: rounded(quality.spikes(panel.densify(bars(s, d)))))
query("zero_volume", f"{DENSE_SQL} SELECT ts, ticker, volume FROM dense WHERE volume IS NULL OR volume = 0")(lambda s, d: quality.zero_volume(panel.densify(bars(s, d))))
query(
    "health_score",
    f"""{DENSE_SQL}, f AS (SELECT close, volume, coalesce(abs(close / lag(close) OVER t - 1) > 0.5, false) AS spike, close IS NULL AND lag(close) OVER t IS NULL AS long_gap FROM dense WINDOW t AS (PARTITION BY ticker ORDER BY ts)),
p AS (SELECT count(close) / count(*) AS filled, 1 - count(*) FILTER (spike) / count(*) AS calm, 1 - count(*) FILTER (coalesce(volume = 0, true)) / count(*) AS traded, 1 - count(*) FILTER (long_gap) / count(*) AS unbroken FROM f)
SELECT {sql_round('filled', 'calm', 'traded', 'unbroken')}, round((filled + calm + traded + unbroken) / 4, 4) AS score FROM p""",
)(lambda s, d: rounded(quality.health_score(panel.densify(bars(s, d)))))

_T = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _filter_sql(value: str, name: str, label: str, table: str = "panel") -> str:
    return f"{PANEL_SQL}, b AS (SELECT *, avg(returns) OVER (PARTITION BY ts) AS bench FROM panel), v AS (SELECT ticker, ts, {value} AS {name} FROM b), l AS (SELECT ticker, arg_max_null({name}, ts) AS {name} FROM v GROUP BY ticker) SELECT ticker, round({name}, 6) AS {name}, {label} AS label FROM l"


query("filter_liquidity", _filter_sql(f"CASE WHEN count(close * volume) OVER {_T.format(19)} >= 10 THEN avg(close * volume) OVER {_T.format(19)} END", "adv20", "CASE WHEN adv20 > 100e6 THEN 'ultra' WHEN adv20 > 50e6 THEN 'high' WHEN adv20 > 10e6 THEN 'medium' WHEN adv20 <= 10e6 THEN 'low' END"))(lambda s, d: rounded(filters.liquidity(std(s, d))))
query("filter_volatility", _filter_sql(f"CASE WHEN count(returns) OVER {_T.format(19)} >= 10 THEN stddev_samp(returns) OVER {_T.format(19)} END", "vol20", "CASE WHEN vol20 > 0.04 THEN 'high' WHEN vol20 > 0.02 THEN 'medium' WHEN vol20 <= 0.02 THEN 'low' END"))(lambda s, d: rounded(filters.volatility(std(s, d))))
query("filter_momentum", _filter_sql("close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY ts) - 1", "mom60", "CASE WHEN mom60 > 0.15 THEN 'up' WHEN mom60 < -0.15 THEN 'down' WHEN mom60 IS NOT NULL THEN 'flat' END"))(lambda s, d: rounded(filters.momentum(std(s, d))))
query("filter_beta", _filter_sql(f"CASE WHEN count(returns) OVER {_T.format(59)} >= 20 THEN covar_samp(coalesce(returns, 0), coalesce(bench, 0)) OVER {_T.format(59)} / var_samp(coalesce(bench, 0)) OVER {_T.format(59)} END", "beta", "CASE WHEN beta > 1.2 THEN 'high' WHEN beta < 0.8 THEN 'low' WHEN beta IS NOT NULL THEN 'neutral' END"))(lambda s, d: rounded(filters.beta(std(s, d))))
query("filter_corr", _filter_sql(f"CASE WHEN count(returns) OVER {_T.format(59)} >= 20 THEN corr(returns, bench) OVER {_T.format(59)} END", "corr", "CASE WHEN corr > 0.7 THEN 'high' WHEN corr < 0.3 THEN 'low' WHEN corr IS NOT NULL THEN 'medium' END"))(lambda s, d: rounded(filters.correlation(std(s, d))))
query(
    "filter_regime",
    f"{PANEL_SQL}, i AS (SELECT ts, avg(close) AS level FROM panel GROUP BY ts), m AS (SELECT ts, level, avg(level) OVER (ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS ma200, avg(level) OVER (ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma50, row_number() OVER (ORDER BY ts) AS n FROM i) SELECT {sql_round('level', 'ma200', 'ma50')}, n::INT AS n, CASE WHEN n < 200 OR abs(level / ma50 - 1) < 0.03 THEN 'sideways' WHEN level < ma200 THEN 'bear' ELSE 'bull' END AS regime FROM m ORDER BY ts DESC LIMIT 1",
)(lambda s, d: rounded(filters.market_regime(std(s, d))))
query("filter_market_cap", "SELECT c_custkey::VARCHAR AS ticker, round(c_acctbal * 1e8, 6) AS cap, CASE WHEN c_acctbal * 1e8 >= 200e9 THEN 'mega' WHEN c_acctbal * 1e8 >= 10e9 THEN 'large' WHEN c_acctbal * 1e8 >= 2e9 THEN 'mid' WHEN c_acctbal * 1e8 < 2e9 THEN 'small' END AS label FROM customer")(lambda s, d: rounded(filters.market_cap(source.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), (F.col("c_acctbal") * 1e8).alias("cap")))))
query("filter_earnings_window", f"{BARS_SQL['nation_week']}, c AS (SELECT ticker, arg_max(ts, volume) + INTERVAL 3 DAY AS earnings FROM (SELECT ticker, ts, volume + epoch(ts) / 1e13 AS volume FROM bars) GROUP BY ticker) SELECT ts, ticker, date_diff('day', ts, earnings)::INT AS days, CASE WHEN date_diff('day', ts, earnings) >= 0 THEN 'before' ELSE 'after' END AS label FROM bars JOIN c USING (ticker) WHERE date_diff('day', ts, earnings) BETWEEN -5 AND 5")(
    lambda s, d: filters.earnings_window(bars(s, d), bars(s, d).groupBy("ticker").agg((F.max_by("ts", F.struct("volume", "ts")) + F.expr("INTERVAL 3 DAY")).alias("earnings"))).select("ts", "ticker", "days", "label")
)
query("filter_combine", "SELECT ticker FROM (" + ORACLE_SQL["filter_liquidity"] + ") WHERE label = 'low' AND ticker IN (SELECT ticker FROM (" + ORACLE_SQL["filter_momentum"] + ") WHERE label IN ('up', 'flat', 'down'))")(lambda s, d: filters.combine([(filters.liquidity(std(s, d)), ["low"]), (filters.momentum(std(s, d)), ["up", "flat", "down"])]))

# --- expressions ---------------------------------------------------------------------------------


def expression(name: str, text: str, sql: str, ctes: str = "") -> None:
    """A query of one expression over the standard panel; sql is its value over the table of that name's last CTE (p: panel)."""
    query(name, f"{PANEL_SQL}, p AS (SELECT * FROM panel){ctes} SELECT ts, ticker, round({sql}, {DP}) AS signal FROM p")(lambda s, d, e=text: rounded(signals(std(s, d), e)))


_W = _T.format(9)


def _strict(value: str, *xs: str) -> str:
    ok = " AND ".join(f"count({x}) OVER {_W} = 10" for x in xs)
    return f"CASE WHEN {ok} THEN {value} END"


for _op, _f in (("mean", "avg"), ("std", "stddev_samp"), ("var", "var_samp"), ("sum", "sum"), ("max", "max"), ("min", "min")):
    expression(f"ts_{_op}", f"ts_{_op}(close, 10)", _strict(f"{_f}(close) OVER {_W}", "close"))
expression("ts_rank", "ts_rank(close, 10)", _strict(f"len(list_filter(list(close) OVER {_W}, lambda v: v <= close)) / 10.0", "close"))
expression("ts_decay_linear", "ts_decay_linear(close, 10)", "(" + " + ".join(f"{10 - k} * lag(close, {k}) OVER (PARTITION BY ticker ORDER BY ts)" if k else "10 * close" for k in range(10)) + ") / 55.0")
expression("ts_decay_linear_long", "ts_decay_linear(close, 30)", "(" + " + ".join(f"{30 - k} * lag(close, {k}) OVER (PARTITION BY ticker ORDER BY ts)" if k else "30 * close" for k in range(30)) + ") / 465.0")
expression("ts_delta", "ts_delta(close, 5)", "close - lag(close, 5) OVER (PARTITION BY ticker ORDER BY ts)")
expression("ts_delay", "ts_delay(close, 3)", "lag(close, 3) OVER (PARTITION BY ticker ORDER BY ts)")
expression("ts_argmax", "ts_argmax(close, 10)", _strict(f"(list_position(list(close) OVER {_W}, max(close) OVER {_W}) - 1) / 9.0", "close"))
expression("ts_argmin", "ts_argmin(close, 10)", _strict(f"(list_position(list(close) OVER {_W}, min(close) OVER {_W}) - 1) / 9.0", "close"))
expression("ts_zscore", "ts_zscore(close, 10)", _strict(f"(close - avg(close) OVER {_W}) / nullif(stddev_samp(close) OVER {_W}, 0)", "close"))
expression("ts_skew", "ts_skew(close, 10)", _strict(f"skewness(close) OVER {_W}", "close"))
expression("ts_kurt", "ts_kurt(close, 10)", _strict(f"(kurtosis_pop(close) OVER {_W} + 3) * 0.81 - 3", "close"))
expression(
    "ts_entropy",
    "ts_entropy(close, 10)",
    "CASE WHEN len(list_filter(l, lambda v: v IS NOT NULL)) = 10 AND len(l) = 10 THEN CASE WHEN hi > lo THEN -list_sum(list_transform(range(0, 10), lambda k: CASE WHEN len(list_filter(l, lambda v: least(9, floor((v - lo) / ((hi - lo) / 10))) = k)) > 0 THEN len(list_filter(l, lambda v: least(9, floor((v - lo) / ((hi - lo) / 10))) = k)) / 10.0 * ln(len(list_filter(l, lambda v: least(9, floor((v - lo) / ((hi - lo) / 10))) = k)) / 10.0) ELSE 0 END)) / ln(10) ELSE 0 END END",
    f", q AS (SELECT ts, ticker, list(close) OVER {_W} AS l, min(close) OVER {_W} AS lo, max(close) OVER {_W} AS hi FROM p), p2 AS (SELECT * FROM q)",
)
ORACLE_SQL["ts_entropy"] = ORACLE_SQL["ts_entropy"].replace("AS signal FROM p", "AS signal FROM p2")
_B = "count(CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN 1 END)"
expression("ts_corr", "ts_corr(close, volume, 10)", f"CASE WHEN {_B} OVER {_W} = 10 THEN corr(close, volume) OVER {_W} * 0.9 END")
expression("ts_cov", "ts_cov(close, volume, 10)", f"CASE WHEN {_B} OVER {_W} = 10 THEN covar_samp(close, volume) OVER {_W} END")
expression("ts_momentum_decay", "ts_momentum_decay(close, 5)", "lag(close, 1) OVER (PARTITION BY ticker ORDER BY ts) - lag(close, 6) OVER (PARTITION BY ticker ORDER BY ts)")


def sql_rank(x: str, by: str = "ts") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / greatest(count({x}) OVER (PARTITION BY {by}) - 1, 1) END"


def sql_z(x: str, by: str = "ts") -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY {by})) / nullif(stddev_samp({x}) OVER (PARTITION BY {by}), 0)"


_C = "OVER (PARTITION BY ts)"
expression("cs_rank", "rank(close)", sql_rank("close"))
expression("cs_rank_ties", "rank(sector)", sql_rank("sector"))
expression("cs_zscore", "zscore(close)", sql_z("close"))
expression("cs_scale", "scale(returns)", f"returns / nullif(sum(abs(returns)) {_C}, 0)")
expression("cs_ind_neutralize", "ind_neutralize(close, sector)", "close - avg(close) OVER (PARTITION BY ts, sector)")
expression("cs_ind_neutralize_default", "ind_neutralize(close)", sql_z("close"))
expression("cs_sector_neutral", "sector_neutral(close, 'sector')", "close - avg(close) OVER (PARTITION BY ts, sector)")
expression("cs_winsorize", "winsorize(returns, 1.5)", f"CASE WHEN returns IS NOT NULL AND stddev_samp(returns) {_C} IS NOT NULL THEN least(greatest(returns, avg(returns) {_C} - 1.5 * stddev_samp(returns) {_C}), avg(returns) {_C} + 1.5 * stddev_samp(returns) {_C}) END")
expression("cs_normalize", "normalize(close)", f"(close - min(close) {_C}) / nullif(max(close) {_C} - min(close) {_C}, 0)")
expression("cs_demean", "demean(close)", f"close - avg(close) {_C}")
expression("group_rank", "group_rank(close, 'sector')", sql_rank("close", "ts, sector"))
expression("group_zscore", "group_zscore(close, sector)", sql_z("close", "ts, sector"))
expression("group_mean", "group_mean(close, sector)", "avg(close) OVER (PARTITION BY ts, sector)")
expression("group_neutralize", "group_neutralize(close, sector)", "close - avg(close) OVER (PARTITION BY ts, sector)")

expression("scalar_arith", "(open + close) * 2 - high / 4", "(open + close) * 2 - high / 4")
expression("scalar_safe_div", "close / (high - low)", "CASE WHEN abs(high - low) >= 1e-8 THEN close / (high - low) END")
expression("scalar_comparisons_null", "(returns > 0) + 2 * (returns <= 0) + 4 * (returns == 0) + 8 * (returns != 0)", "coalesce((returns > 0)::INT, 0) + 2 * coalesce((returns <= 0)::INT, 0) + 4 * coalesce((returns = 0)::INT, 0) + 8 * coalesce((returns != 0)::INT, 1)::DOUBLE")
expression("scalar_log_sqrt_sign", "log(returns) + sqrt(returns) + sign(returns) + abs(returns)", "CASE WHEN returns > 0 THEN ln(returns) END + CASE WHEN returns >= 0 THEN sqrt(returns) END + sign(returns) + abs(returns)")
expression("scalar_signed_power", "signed_power(returns, 0.5)", "sign(returns) * pow(abs(returns), 0.5)")
expression("scalar_if_else", "if_else(close > open, close, open)", "CASE WHEN coalesce(close > open, false) THEN close ELSE open END")
expression("scalar_trade_when", "trade_when(returns, close)", "CASE WHEN coalesce(returns != 0, true) THEN close ELSE 0 END")
expression("scalar_logic", "(returns && (close > open)) + 2 * (!returns) + 4 * ((close < open) || returns)", "(coalesce(returns != 0, true) AND coalesce(close > open, false))::INT + 2 * (NOT coalesce(returns != 0, true))::INT + 4 * (coalesce(close < open, false) OR coalesce(returns != 0, true))::INT::DOUBLE")
expression("scalar_pow", "pow(returns, 0.5) + pow(close, 2)", "CASE WHEN returns >= 0 THEN pow(returns, 0.5) END + pow(close, 2)")
expression("scalar_max_min", "max(returns, 0) - min(close, open)", "CASE WHEN returns IS NOT NULL THEN greatest(returns, 0) END - CASE WHEN close IS NOT NULL AND open IS NOT NULL THEN least(close, open) END")
expression("scalar_weighted_sum", "weighted_sum(close, 0.5, open, 0.3, high, 0.2)", "close * 0.5 + open * 0.3 + high * 0.2")

_O = "OVER (PARTITION BY ticker ORDER BY ts)"
expression("alpha_momentum", "rank(ts_delta(log(close), 5))", sql_rank("x"), f", p2 AS (SELECT ts, ticker, ln(close) - lag(ln(close), 5) {_O} AS x FROM p)")
expression("alpha_momentum_vol", "rank(ts_delta(log(close), 5)) / ts_std(close, 20)", f"{sql_rank('x')} / CASE WHEN sd >= 1e-8 THEN sd END", f", p2 AS (SELECT ts, ticker, ln(close) - lag(ln(close), 5) {_O} AS x, CASE WHEN count(close) OVER {_T.format(19)} = 20 THEN stddev_samp(close) OVER {_T.format(19)} END AS sd FROM p)")
expression("alpha_reversal", "-zscore(ts_mean(returns, 5))", f"-({sql_z('x')})", f", p2 AS (SELECT ts, ticker, CASE WHEN count(returns) OVER {_T.format(4)} = 5 THEN avg(returns) OVER {_T.format(4)} END AS x FROM p)")
expression("alpha_volume", "(close > open) && (volume > ts_mean(volume, 10))", f"(coalesce(close > open, false) AND coalesce(volume > CASE WHEN count(volume) OVER {_W} = 10 THEN avg(volume) OVER {_W} END, false))::INT::DOUBLE")
expression("alpha_tct", "ts_mean(rank(ts_delta(close, 2)), 5)", f"CASE WHEN count(r) OVER {_T.format(4)} = 5 THEN avg(r) OVER {_T.format(4)} END", f", p1 AS (SELECT ts, ticker, close - lag(close, 2) {_O} AS x FROM p), p2 AS (SELECT ts, ticker, {sql_rank('x')} AS r FROM p1)")
expression("alpha_group_vwap", "group_neutralize(rank(vwap / close), sector)", "r - avg(r) OVER (PARTITION BY ts, sector)", f", p1 AS (SELECT ts, ticker, sector, vwap / close AS x FROM p), p2 AS (SELECT ts, ticker, sector, {sql_rank('x')} AS r FROM p1)")
for _name in ("alpha_momentum", "alpha_momentum_vol", "alpha_reversal", "alpha_tct", "alpha_group_vwap"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("AS signal FROM p", "AS signal FROM p2")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["alpha_momentum"](spark, sf_dir)


from . import catalogue_backtest  # noqa: E402, F401  adds its queries
