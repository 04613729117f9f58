"""Panel, portfolio, backtest, search and monitoring."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataloom.operators import backtest, combine, ledger, metrics, panel, portfolio, search, signal, validation
from strataloom.plans.parser import parse
from strataloom.sources import bars, store


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["ts", "ticker", "signal"] and out.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["alpha_tct", "portfolio_decile", "metrics_summary", "walk_forward_folds", "gaps_islands", "decay_alert"])
def test_queries_match_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    texts = [c for c in cols if got[c].dtype.kind not in "fi"]
    numbers = [c for c in cols if c not in texts]
    key = texts or numbers
    a, b = (x[cols].sort_values([*key, *(c for c in numbers if c not in key)]).reset_index(drop=True) for x in (got, want))
    for c in texts:
        assert (a[c].astype(str) == b[c].astype(str)).all()
    for c in numbers:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True)


def test_schema(spark):
    raw = spark.createDataFrame([("2024-01-01", " aa ", "1.5", 1), ("2024-01-01", "AA", "2.5", 2), ("bad", "BB", "1", 3), ("2024-01-02", "BB", "x", 4)], " Timestamp  string, TICKER string, close string, extra int")
    out = {(r.ticker, str(r.ts)[:10]): r for r in panel.enforce_schema(raw.withColumnRenamed(" Timestamp ", "Timestamp"), order_col="extra").collect()}
    assert out["AA", "2024-01-01"].close == 2.5 and out["BB", "2024-01-02"].close is None and out["AA", "2024-01-01"].adj_factor == 1.0 and len(out) == 2
    with pytest.raises(panel.SchemaError):
        panel.enforce_schema(spark.createDataFrame([(1,)], "x int"))


def test_store(spark, sf, tmp_path):
    df = bars.nation_week(spark, sf).select("ts", "ticker", "close", "volume")
    path = str(tmp_path / "features")
    store.save_features(df, path)
    store.save_features(df.where("year(ts) = 1996").withColumn("close", F.lit(1.0)), path)
    back = store.load_features(spark, path, "1996-01-01", "1996-12-31", fields=["close"])
    assert back.select("close").distinct().collect()[0][0] == 1.0
    assert store.load_features(spark, path).count() == df.count()
    assert store.covers(df, "1996-01-01", "1996-06-01", [df.first().ticker])


def test_ffill_limit(spark):
    rows = [(i, "A", 1.0 if i == 0 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "d int, ticker string, close double").selectExpr("timestamp_seconds(d * 86400) AS ts", "ticker", "close")
    out = panel.ffill(df, ["close"], 5).orderBy("ts").collect()
    assert [r.close for r in out] == [1.0] * 6 + [None, None]


def test_config_errors():
    for bad in ({"delay": -1}, {"q_min": 0.6}, {"mode": "x"}, {"top": 0.7}):
        with pytest.raises(ValueError):
            signal.SignalConfig(**bad)


@pytest.fixture(scope="module")
def book(spark, sf):
    from strataloom.catalogue_backtest import weighted

    return weighted(spark, sf).cache()


def test_portfolio_invariants(book):
    w = portfolio.market_neutral(book).groupBy("ts").agg(F.sum("weight").alias("s"), F.sum(F.abs("weight")).alias("a")).where("a > 0").toPandas()
    assert np.allclose(w.s, 0, atol=1e-9) and np.allclose(w.a, 1)
    d = portfolio.decile(book, 0.2).groupBy("ts").agg(F.sum("weight").alias("s"), F.sum(F.abs("weight")).alias("a")).where("a > 0").toPandas()
    assert np.allclose(d.s, 0, atol=1e-9) and np.allclose(d.a, 2)
    m = portfolio.mvo(book.withColumn("alpha_id", F.lit("a"))).groupBy("ts").agg(F.sum(F.abs("weight")).alias("a")).toPandas()
    assert (np.isclose(m.a, 1) | np.isclose(m.a, 0)).all()


def test_equity_fold_matches_a_loop(book):
    legs = backtest.legs(portfolio.with_adv(book)).withColumn("change", F.col("change") * 0.001).cache()
    got = backtest.equity_curve(legs).orderBy("ts").toPandas()
    c, equity, want = portfolio.Costs(), 1.0, []
    for _, day in sorted(legs.toPandas().groupby("ts")):
        gross = float((day.w0 * day.change.fillna(0)).sum())
        borrow = float((-day.w0).clip(lower=0).sum()) * c.borrow / 252
        share = 0.0
        if equity > 0:
            for dw, vol, adv in zip(day.dw.abs(), day.vol, day.adv, strict=True):
                if dw >= 1e-10:
                    value = dw * equity * c.capital
                    bps = c.commission_bps + c.spread_bps / 2 + c.impact * 1e4 * vol * math.sqrt(value / adv if adv > 0 else 0)
                    share += max(value * bps / 1e4, c.minimum)
            share /= equity * c.capital
            equity = max(0.0, equity * (1 + gross - share - borrow))
        want.append(equity)
    assert np.allclose(got.equity, want, rtol=1e-9)


def test_ruin_ends_the_curve(spark):
    df = spark.createDataFrame([(0, 0.1), (1, -1.2), (2, 0.5)], "d int, r double").selectExpr("timestamp_seconds(d * 86400) AS ts", "r")
    assert [round(r.equity, 6) for r in metrics.drawdown(df).orderBy("ts").collect()] == [1.1, 0.0, 0.0]


@pytest.mark.parametrize("name", ["drawdown", "max_drawdown", "calmar"])
@pytest.mark.parametrize("returns", [[0.1, -0.5, 0.2, -1.5, 0.3], [0.1, -1.0, 0.5, -1.2, 0.1], [0.1, -1.0, 0.5], [-1.5, 0.1]])
def test_losses_of_more_than_all_match_sql(spark, monkeypatch, name, returns):
    """The queries' SQL takes logarithms: what a loss of more than all leaves is not a number there, and no low."""
    import duckdb

    from strataloom import catalogue_backtest as catalogue

    df = spark.createDataFrame(list(enumerate(returns)), "d int, r double").selectExpr("timestamp_seconds(d * 86400) AS ts", "r")
    monkeypatch.setattr(catalogue, "series", lambda s, d: df)
    given = ", ".join(f"(TIMESTAMP '1970-01-01' + INTERVAL {i} DAY, {r}::DOUBLE)" for i, r in enumerate(returns))
    want = duckdb.sql(entry.oracle_sql()[name].replace(catalogue.DAY_SQL, f"WITH series AS (SELECT * FROM (VALUES {given}) t(ts, r))")).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_equity_fold_of_keys_and_batches(book, spark):
    """Keys are folded apart, and days that lie across Arrow batches are one day."""
    legs = backtest.legs(portfolio.with_adv(book)).withColumn("change", F.col("change") * 0.001).cache()
    one = backtest.equity_curve(legs).orderBy("ts").toPandas()
    two = legs.withColumn("key", F.lit("a")).unionByName(legs.withColumn("key", F.lit("b")).where("ts < '1998-01-01'"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = backtest.equity_curve(two, ("key",)).orderBy("ts").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert np.allclose(got[got.key == "a"].equity, one.equity) and np.allclose(got[got.key == "a"].net, one.net)
    assert np.allclose(got[got.key == "b"].equity, one[one.ts < "1998-01-01"].equity)
    live = one.equity > 0
    assert np.allclose((1 + one.net).cumprod()[live], one.equity[live]) and (one.net[~live].iloc[1:] == 0).all()


def test_mvo_by_date_ranges(book):
    """Chunks of dates with the window before them give what the whole panel gives."""
    rows = book.withColumn("alpha_id", F.lit("a"))
    whole, parts = (portfolio.mvo(rows, rows_a_task=n).orderBy("ts", "ticker").toPandas() for n in (10_000, 70))
    assert len(whole) == len(parts) == book.count() and np.allclose(whole.weight, parts.weight)


def test_deflated_sharpe(spark):
    from statistics import NormalDist

    r = list(np.random.default_rng(0).normal(0.001, 0.01, 300))
    rows = [(k, float(x)) for k, v in (("a", r), ("few", r[:10]), ("flat", [0.01] * 30)) for x in v]
    df = spark.createDataFrame(rows, "alpha_id string, r double")
    got = {n: {x.alpha_id: x.dsr for x in metrics.deflated_sharpes(df, n).collect()} for n in (1, 10, 1000)}
    assert got[1]["a"] > got[10]["a"] > got[1000]["a"] and got[10]["few"] is None and got[10]["flat"] is None
    x = np.array(r)
    m, sr = x - x.mean(), x.mean() / x.std(ddof=1)
    skew, kurt = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2
    var = (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (len(x) - 1)
    assert abs(got[1]["a"] - NormalDist().cdf(sr / math.sqrt(var))) < 1e-6


def test_split_and_folds():
    axis = list(range(100))
    assert validation.split_bounds(axis, 0.3, 10) == (70, 80)
    with pytest.raises(ValueError):
        validation.split_bounds(axis[:20], 0.3, 20)
    f = validation.folds(300, 4, 120, 20)
    assert len(f) == 4 and all(a1 + 20 < b0 for _, _, a1, b0, _ in f) and f[-1][-1] <= 299
    assert validation.folds(140, 5) == []


def test_input_checks(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "ticker string, close double").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    with pytest.raises(ValueError, match="twice"):
        validation.check_panel(df)
    with pytest.raises(ValueError, match="missing"):
        validation.check_panel(df.drop("close"))


def test_pool():
    pool = combine.AlphaPool(max_size=2, threshold=0.9)
    rng = np.random.default_rng(0)
    a, b, c = (list(rng.normal(size=30)) for _ in range(3))
    assert pool.add("a", 1.0, a) and not pool.add("a", 2.0, a) and not pool.add("a2", 2.0, [2 * x + 1 for x in a])
    assert pool.add("b", 3.0, b) and pool.add("c", 2.0, c) and [d for d, _ in pool.top(5)] == ["b", "c"]
    assert pool.components().shape == (2, 30)


def test_weights():
    assert combine.ic_weights({"a": 0.02, "b": -0.1}) == {"a": 1.0, "b": 0.0}
    assert combine.ic_weights({"a": -1.0, "b": None}) == {"a": 0.5, "b": 0.5}
    w = combine.regime_weights([("m", "momentum", 1.0), ("r", "reversion", 1.0), ("q", "quality", 1.0)], "bull")
    assert math.isclose(w["m"], 1.5 / 3.25) and math.isclose(w["r"], 0.75 / 3.25) and math.isclose(sum(w.values()), 1)


def test_min_variance(spark):
    rng = np.random.default_rng(2)
    rows = [(n, t, float(v)) for n, s in (("calm", 0.01), ("wild", 0.1)) for t, v in enumerate(rng.normal(0, s, 200))]
    w = combine.min_variance_weights(spark.createDataFrame(rows, "alpha_id string, ts int, r double"), ["calm", "wild"])
    assert w["calm"] > 0.9 and math.isclose(sum(w.values()), 1)


def test_mutations_give_valid_trees():
    rng = random.Random(3)
    a, b = parse("rank(ts_delta(log(close), 5)) / ts_std(close, 20)"), parse("zscore(volume)")
    changed = 0
    for name, f in search.MUTATIONS.items():
        for _ in range(10):
            t = f(a, rng, b)
            assert parse(str(t)) == t, name
            changed += t != a
    assert changed > 80
    assert math.isclose(sum(search.adapted({k: 1.0 for k in search.MUTATIONS}, 200, 0.6, 0.0).values()), 1)


def test_evolution_repeats(spark, sf):
    from strataloom.catalogue import std

    p = std(spark, sf).cache()
    one, pool = search.evolve(p, generations=1, size=6, seed=1)
    two, _ = search.evolve(p, generations=1, size=6, seed=1)
    assert [str(x.tree) for x in one] == [str(x.tree) for x in two] and pool.diagnostics()["size"] > 0
    vectors = [v for _, v in pool.members.values()]
    assert all(len(v) > 100 for v in vectors) and all(abs(combine.AlphaPool._corr(a, b) or 0) < 0.7 for i, a in enumerate(vectors) for b in vectors[:i])


def test_tuning(spark, sf):
    """A seeded search repeats itself, sees in-sample dates only, and gives its settings best first."""
    from strataloom import api
    from strataloom.catalogue import std

    p = std(spark, sf).cache()
    one = api.optimize(p, "rank(ts_delta(close, 5))", trials=4, seed=2)
    assert one and [x["fitness"] for x in one] == sorted((x["fitness"] for x in one), reverse=True)
    later = p.withColumn("close", F.when(F.col("ts") >= "2001-01-01", F.col("close") * 2).otherwise(F.col("close")))
    assert [str(x) for x in api.optimize(later, "rank(ts_delta(close, 5))", trials=4, seed=2)] == [str(x) for x in one]


def test_interpretation():
    families = {"rank(ts_delta(close, 5))": "momentum", "rank(-ts_delta(close, 3))": "reversion", "rank(ts_delta(close, 60))": "trend_following", "rank(-ts_std(returns, 20))": "volatility", "rank(-ts_mean(volume, 20))": "liquidity", "rank(-ts_corr(close, volume, 10))": "price_volume_corr", "ts_skew(close, 9)": "quality", "rank(ts_delta(close, 5) / ts_std(close, 5))": "composite", "ts_zscore(close, 9)": "reversion", "ts_mean(close, 9)": "trend_following"}
    assert {e: search.interpret(e)["family"] for e in families} == families
    assert all(search.interpret(e) for f in search.SEEDS.values() for e in f)
    stable = {"rank(close)": True, "rank(close) * volume": False, "close / volume": False, "rank(close) / 2": True, "rank(close) / rank(volume)": False, "ts_mean(rank(close), 5)": True, "winsorize(close, 3)": False, "close > open": True, "if_else(close > open, rank(close), 1)": True, "trade_when(close > open, close)": False, "ts_corr(close, volume, 9)": True, "log(close)": False}
    assert {e: search.scale_free(parse(e)) for e in stable} == stable
    assert "not scale-free" in search.interpret("close + volume")["issues"]
    assert search.surrogate(None, [])("close") == 0.3


def test_lifecycle(spark):
    rows = [("a", 1, "candidate"), ("a", 2, "validated"), ("a", 3, "validated"), ("a", 4, "active"), ("a", 5, "superseded"), ("b", 1, "retired"), ("b", 2, "active")]
    bad = ledger.illegal_transitions(spark.createDataFrame(rows, "alpha_id string, at int, status string")).select("alpha_id", "before", "status").collect()
    assert {tuple(r) for r in bad} == {("a", "validated", "active"), ("b", "retired", "active")}


def test_streaming_matches_batch(spark, sf):
    out = {r.alpha_id: r for r in entry.queries()["stream_ic_monitor"](spark, sf).groupBy("alpha_id").agg(F.max("n").alias("n")).collect()}
    days = {r.user: r.n for r in spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").cast("string").alias("user")).agg(F.countDistinct(F.to_date("ts")).alias("n")).collect()}
    assert out and all(r.n <= days[k] for k, r in out.items())
    assert sum(r.n for r in out.values()) >= 0.8 * sum(days.values())  # the watermark holds the last days back


def test_realistic_run(spark, sf):
    from strataloom import api

    p = api.load_panel(spark, sf).cache()
    out = api.run_backtest(p, "rank(ts_delta(log(close), 5))")
    report = {r.segment: r for r in out["report"].collect()}
    assert set(report) == {"IS", "OOS"} and all(-1 <= r.mdd <= 0 or r.mdd is not None for r in report.values())
    assert out["daily"].where("turnover < 0 OR turnover > 1.0000001").count() == 0
    # net is what is left of gross, and the report is on net
    assert out["daily"].where("equity > 0 AND net > gross + 1e-12").count() == 0 and out["daily"].where("equity > 0 AND turnover > 0 AND net < gross").count() > 0
    day = out["daily"].where("segment = 'IS'").toPandas()
    assert math.isclose(report["IS"].ann_return, (1 + day.net.mean()) ** report["IS"].td - 1, rel_tol=1e-6)
    assert {"calmar", "var5", "dsr", "beta", "long_sharpe", "mdd_days"} <= set(out["report"].columns) and out["stress"].count() >= 6
    from strataloom.operators.signal import SignalConfig

    assert api.run_backtest(p, "rank(ts_delta(close, 5))", SignalConfig(mode="mvo"))["report"].count() == 2
    assert api.run_walk_forward(p, "rank(ts_delta(close, 3))")["folds"].count() == 10
    assert "nation_week" in api.datasets() and abs(sum(api.workflow_optimize(p, "rank(ts_delta(close, 3))", size=4)["weights"].values()) - 1) < 1e-9


def test_providers(spark, tmp_path):
    from strataloom.sources import provider

    p = provider.fetch(spark, ["nosuch", "synthetic"], ["T000", "T001"], "2022-01-03", "2022-02-01")
    rows = p.toPandas()
    assert set(rows.ticker) == {"T000", "T001"} and (rows.high >= rows.close).all() and (rows.ts.dt.weekday < 5).all()
    local = provider.LocalParquet(str(tmp_path / "panel"))
    local.save(p)
    back = local.fetch_panel(spark, ["T001"], "2022-01-05", "2022-01-20", ["close"])
    assert back.columns == ["ts", "ticker", "close"] and 0 < back.count() < 15
    # a second save replaces keys and keeps the others
    local.save(p.where("ticker = 'T001'").withColumn("close", F.lit(7.0)))
    again = local.fetch_panel(spark, None, "2022-01-03", "2022-02-01").toPandas()
    assert len(again) == len(rows) and set(again[again.ticker == "T001"].close) == {7.0} and (again[again.ticker == "T000"].close != 7.0).all()
    provider.register_provider("local", local)
    with pytest.raises(LookupError):
        provider.fetch(spark, ["local"], ["nosuch"], "2022-01-05", "2022-01-20")


def test_get_panel(spark, tmp_path):
    from strataloom import api

    store = str(tmp_path / "store")
    ask = lambda chain: api.get_panel(spark, chain, ["t000", "t001", "t002"], "2022-01-03", "2022-02-01", store)
    one, report = ask(["nosuch", "synthetic"])
    rows = one.toPandas()
    assert set(rows.ticker) == {"T000", "T001", "T002"} and rows.groupby("ticker").ts.nunique().nunique() == 1 and report.count() >= 1 and "returns" in rows
    # the second time the stored panel serves, so no provider is asked
    start, end = rows.ts.min(), rows.ts.max()
    two, _ = api.get_panel(spark, [], ["T000", "T001", "T002"], str(start), str(end), store)
    assert np.allclose(two.orderBy("ticker", "ts").toPandas().close, rows.sort_values(["ticker", "ts"]).close)
    known = spark.createDataFrame([("2022-01-01", "T000", True), ("2022-01-10", "T001", False)], "date string, ticker string, active boolean").withColumn("date", F.to_timestamp("date"))
    some, _ = api.get_panel(spark, ["synthetic"], ["T000", "T001"], "2022-01-03", "2022-02-01", universe=known)
    assert {r.ticker for r in some.select("ticker").distinct().collect()} == {"T000"}


def test_metadata_union():
    from strataloom.sources.store import merged_metadata

    got = merged_metadata({"start_ts": "2020", "end_ts": "2021", "tickers": ["a"], "fields": ["close"]}, {"start_ts": "2019", "end_ts": "2020", "tickers": ["b"], "fields": ["close", "open"]})
    assert got == {"start_ts": "2019", "end_ts": "2021", "tickers": ["a", "b"], "fields": ["close", "open"]}
