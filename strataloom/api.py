"""The engine's surface as functions: what a service or the command line calls."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import combine, ledger, metrics, panel, quality, realistic, search, validation
from .operators.signal import SignalConfig, post_process
from .plans.compiler import signals
from .sources import bars, provider, store


def datasets() -> list[str]:
    return sorted(bars.LOADERS)


def load_panel(spark: SparkSession, sf_dir: str, dataset: str = "nation_week") -> DataFrame:
    return panel.standard_panel(bars.load_dataset(spark, sf_dir, dataset))


def simulate(p: DataFrame, expression: str, winsorize: float | None = None, centre: bool = False) -> DataFrame:
    return post_process(signals(p, expression), winsorize, centre)


def run_backtest(p: DataFrame, expression: str, config: SignalConfig = SignalConfig()) -> dict[str, DataFrame]:
    return realistic.run(p, {"alpha": expression}, config)


def run_walk_forward(p: DataFrame, expression: str, config: SignalConfig = SignalConfig(), folds: int = 5) -> dict[str, DataFrame]:
    return realistic.walk_forward(p, expression, config, folds)


def run_multi(spark: SparkSession, sf_dir: str, names: list[str], expression: str) -> DataFrame:
    """OOS Sharpe per dataset, then over all of them."""
    per = None
    for n in names:
        one = realistic.run(load_panel(spark, sf_dir, n), {"alpha": expression})["report"].where("segment = 'OOS'").select(F.lit(n).alias("dataset"), "sharpe", F.col("n").alias("n_oos"))
        per = one if per is None else per.unionByName(one)
    return validation.across_datasets(per)


def optimize(p: DataFrame, expression: str, trials: int = 16, seed: int = 0, oos: float = 0.3) -> list[dict]:
    """Settings of one expression, best first: a seeded search that sees the in-sample dates only."""
    return search.tune(validation.with_segment(p, oos).where("segment = 'IS'").drop("segment"), expression, trials, seed)


def evolve(p: DataFrame, generations: int = 2, size: int = 12, seed: int = 0, tuning: int = 0) -> list[dict]:
    """The last generation, best first; with tuning, the winner's settings after as many trials."""
    out = [{"dsl": str(i.tree), "score": i.score} for i in search.evolve(p, generations, size, seed)[0]]
    if tuning and out:
        out[0]["config"] = next(iter(optimize(p, out[0]["dsl"], tuning, seed)), None)
    return out


def get_panel(spark: SparkSession, chain: list[str], tickers: list[str], start: str, end: str, store_path: str | None = None, universe: DataFrame | None = None, as_of: str | None = None, ffill: int = 5, check: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(panel, health or None): the stored panel where it covers the range and tickers, else the first provider that has rows; schema, the full grid of dates and tickers, the universe as it was known at as_of, adjustment, derived fields and limited fills; then written back to the store."""
    tickers = [t.upper() for t in tickers]
    raw = None
    if store_path and store.exists(spark, store_path):
        kept = store.load_features(spark, store_path, start, end, tickers)
        if store.covers(kept, start, end, tickers):
            raw = kept
    fetched = raw is None
    if fetched:
        raw = provider.fetch(spark, chain, tickers, start, end)
    if "sector" not in raw.columns:
        raw = raw.withColumn("sector", F.lit(-1))
    rows = panel.densify(panel.enforce_schema(raw.drop("returns", "simple_returns"), keep_extra=True))
    if universe is not None:
        rows = panel.universe_asof(rows, universe, as_of or end)
    made = panel.derived(panel.ffill(panel.adjust(rows), panel.FILLED, ffill))
    if store_path and fetched:
        store.save_features(raw, store_path)
    return made, quality.health_score(made) if check else None


def health(p: DataFrame) -> DataFrame:
    return quality.health_score(p)


def regime(p: DataFrame) -> DataFrame:
    return combine.regimes(p.groupBy("ts").agg(F.coalesce(F.avg("simple_returns"), F.lit(0.0)).alias("r")))


def dashboard(alphas: DataFrame, history: DataFrame) -> DataFrame:
    return ledger.dashboard(alphas, history)


def workflow_generate(p: DataFrame, hypothesis: str, generations: int = 1, size: int = 8, seed: int = 0, top: int = 3) -> dict:
    """Seeds of the families that the hypothesis names (all if none), evolution, and the IC-weighted combination of the best."""
    text = hypothesis.lower()
    families = [f for f in search.SEEDS if f in text] or list(search.SEEDS)
    people, _ = search.evolve(p, generations, size, seed, seeds=[e for f in families for e in search.SEEDS[f]])
    return _combined(p, [str(i.tree) for i in people[:top]])


def workflow_optimize(p: DataFrame, expression: str, size: int = 8, seed: int = 0, top: int = 3) -> dict:
    """Mutations of one expression, evaluated in one plan, and the combination of the best."""
    import random

    from .plans.parser import parse

    rng, tree = random.Random(seed), parse(expression)
    made = [expression]
    while len(made) < size:
        name = rng.choice(sorted(search.MUTATIONS))
        child = str(search.MUTATIONS[name](tree, rng, parse(rng.choice(search.SEEDS["momentum"]))))
        if child not in made and parse(child).depth() <= 10:
            made.append(child)
    found = sorted((m for m in search.evaluate(p, made) if m.get("fitness") is not None), key=lambda m: -m["fitness"])
    return _combined(p, [m["dsl"] for m in found[:top]])


def _combined(p: DataFrame, expressions: list[str]) -> dict:
    names = {f"a{i}": e for i, e in enumerate(expressions)}
    long = signals(p, names, keep=("ts", "ticker", "close")).unpivot(["ts", "ticker", "close"], list(names), "alpha_id", "signal")
    ics = {r.alpha_id: r.ic_mean for r in metrics.ic_ir(metrics.rank_ic(long, ("alpha_id",)), ("alpha_id",)).collect()}
    weights = combine.ic_weights({k: ics.get(k) or 0.0 for k in names})
    return {"expressions": names, "weights": weights, "signal": combine.combine(long, weights)}


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="strataloom")
    a.add_argument("mode", choices=["datasets", "signal", "backtest", "report", "walk_forward", "multi", "optimize", "evolve", "workflow", "health"])
    a.add_argument("--data", default="/root/testdata/sf0.01")
    a.add_argument("--dataset", default="nation_week")
    a.add_argument("--datasets", nargs="+", default=["nation_week", "brand_week"])
    a.add_argument("--expression", default="rank(ts_delta(log(close), 5))")
    a.add_argument("--portfolio", choices=["long_short", "decile", "mvo"], default="long_short")
    a.add_argument("--trials", type=int, default=16)
    args = a.parse_args(argv)
    if args.mode == "datasets":
        print(json.dumps(datasets()))
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.mode == "multi":
        run_multi(spark, args.data, args.datasets, args.expression).show(truncate=False)
        return
    p, config = load_panel(spark, args.data, args.dataset), SignalConfig(mode=args.portfolio)
    if args.mode in ("backtest", "report"):
        out = run_backtest(p, args.expression, config)
        for name in ("report", "overfit") if args.mode == "backtest" else ("report", "overfit", "stress", "deciles"):
            out[name].show(truncate=False)
    elif args.mode == "walk_forward":
        run_walk_forward(p, args.expression, config)["summary"].show(truncate=False)
    elif args.mode == "workflow":
        out = workflow_optimize(p, args.expression)
        print(json.dumps({k: out[k] for k in ("expressions", "weights")}))
    elif args.mode in ("optimize", "evolve"):
        print(json.dumps(optimize(p, args.expression, args.trials) if args.mode == "optimize" else evolve(p, tuning=args.trials), default=str))
    else:
        {"signal": simulate}.get(args.mode, lambda x, _: health(x))(p, args.expression).show()


if __name__ == "__main__":
    main()
