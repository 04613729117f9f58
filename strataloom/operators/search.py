"""Evolutionary search over expressions. The driver holds the trees; a generation is evaluated in one Spark plan."""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import ts_decay_linear

from ..plans.ast import Node, call, data, number
from ..plans.compiler import signals
from ..plans.parser import ExpressionError, parse, validate
from ..sources.store import materialise
from . import realistic
from .combine import AlphaPool, fingerprint
from .metrics import max_drawdown, quick_ic, summary, turnover_analysis
from .signal import SignalConfig, truncate
from .validation import ordered_axis, with_ratio_split

#: Seed expressions by factor family.
SEEDS = {
    "momentum": ["rank(ts_delta(log(close), 5))", "rank(ts_delta(log(close), 10))", "rank(ts_delta(log(close), 20))", "rank(ts_delta(log(close), 40))", "zscore(ts_delta(log(close), 5))", "rank(ts_delta(vwap, 10))", "rank(ts_rank(close, 20))", "rank(ts_rank(returns, 10))"],
    "reversion": ["rank(-ts_delta(close, 1))", "rank(-ts_delta(close, 3))", "rank(-ts_delta(close, 5))", "rank(-ts_rank(close, 5))", "rank(ts_zscore(returns, 10))", "zscore(-ts_delta(close, 3))"],
    "volatility": ["rank(-ts_std(returns, 20))", "rank(-ts_std(returns, 60))", "rank(-ts_var(returns, 20))", "zscore(-ts_std(returns, 10))", "rank(-ts_std(close, 20))"],
    "risk_adjusted": ["rank(ts_delta(log(close), 20) / ts_std(returns, 20))", "rank(ts_delta(log(close), 10) / ts_std(returns, 10))", "rank(ts_mean(returns, 20) / ts_std(returns, 20))", "rank(ts_delta(log(close), 5) / ts_std(returns, 5))", "rank(ts_delta(log(vwap), 10) / ts_std(returns, 20))"],
    "liquidity": ["rank(-ts_mean(volume, 20))", "rank(-ts_mean(volume, 60))", "rank(ts_delta(log(volume), 5))", "rank(ts_delta(log(volume), 10))", "zscore(ts_mean(volume, 10))", "rank(ts_std(volume, 20))"],
    "price_volume_corr": ["rank(-ts_corr(close, volume, 20))", "rank(-ts_corr(close, volume, 10))", "rank(ts_corr(returns, volume, 20))", "rank(-ts_corr(vwap, volume, 20))", "zscore(-ts_corr(close, volume, 10))"],
    "trend_following": ["rank(ts_mean(close, 60))", "rank(ts_mean(close, 120))", "rank(ts_mean(returns, 20))", "rank(ts_decay_linear(close, 20))", "rank(ts_decay_linear(returns, 10))"],
    "composite": ["rank(ts_delta(log(close), 10) * ts_delta(log(volume), 5))", "rank(ts_rank(close, 20) + ts_rank(volume, 10))", "rank(ts_delta(log(close), 10) - ts_std(returns, 20))", "rank(ts_delta(log(close), 5) - ts_delta(log(close), 20))", "rank(ts_mean(returns, 5) / ts_std(returns, 20))", "rank(-ts_delta(log(close), 3) + ts_delta(log(close), 20))", "rank(ts_delta(vwap, 5) + ts_delta(log(volume), 5))"],
    "conditional": ["rank(trade_when(close > ts_mean(close, 60), ts_delta(log(close), 10)))", "rank(trade_when(volume > ts_mean(volume, 20), -ts_delta(close, 3)))", "rank(trade_when(close > ts_mean(close, 20), ts_rank(close, 10)))"],
}
#: Operators that tell a factor family.
MARKS = {"momentum": {"ts_delta", "ts_rank", "ts_argmax", "ts_argmin"}, "volatility": {"ts_std", "ts_var"}, "quality": {"ts_entropy", "ts_skew", "ts_kurt"}}
#: Operators whose output has no scale of its own.
SCALE_FREE = {"rank", "zscore", "scale", "normalize", "ts_rank", "ts_zscore", "ts_corr", "group_rank", "group_zscore", "sign", "not", "and", "or", "!", "&&", "||", ">", "<", ">=", "<=", "==", "!="}
FIELDS = ("close", "open", "high", "low", "volume", "vwap", "returns")
SMOOTH = ("ts_mean", "ts_decay_linear", "ts_zscore", "ts_rank")
CONDITIONS = ("close > ts_mean(close, 20)", "ts_delta(close, 5) > 0", "high > ts_delay(ts_max(high, 20), 1)", "returns > 0", "ts_mean(close, 5) > ts_mean(close, 20)")


def paths(n: Node, at: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Node]]:
    """Every subtree that may be replaced, with its path: windows, group names and constants of functions stay."""
    out = [(at, n)]
    for i, a in enumerate(n.args):
        fixed = n.kind == "ts" and i == len(n.args) - 1 or n.kind in ("group", "cs") and i == 1
        if not fixed and a.kind != "text":
            out += paths(a, (*at, i))
    return out


def replaced(n: Node, at: tuple[int, ...], new: Node) -> Node:
    if not at:
        return new
    args = tuple(replaced(a, at[1:], new) if i == at[0] else a for i, a in enumerate(n.args))
    return Node(n.kind, n.name, args, n.value)


def random_tree(rng: random.Random, depth: int = 3) -> Node:
    if depth <= 1:
        return data(rng.choice(FIELDS))
    kind = rng.random()
    if kind < 0.45:
        return call(rng.choice(("ts_mean", "ts_std", "ts_delta", "ts_rank", "ts_zscore", "ts_min", "ts_max")), random_tree(rng, depth - 1), number(rng.choice((3, 5, 10, 20))))
    if kind < 0.7:
        return call(rng.choice(("rank", "zscore", "demean")), random_tree(rng, depth - 1))
    return Node("binary", rng.choice("+-*/"), (random_tree(rng, depth - 1), random_tree(rng, depth - 1)))


def point(n, rng, _):
    """Another operator of the same shape, or another field."""
    at, x = rng.choice(paths(n))
    if x.kind == "field":
        return replaced(n, at, data(rng.choice([f for f in FIELDS if f != x.name])))
    same = {"ts": ("ts_mean", "ts_std", "ts_delta", "ts_rank", "ts_zscore"), "cs": ("rank", "zscore", "demean"), "binary": ("+", "-", "*", "/")}.get(x.kind, ())
    if x.name not in same:
        return n
    return replaced(n, at, Node(x.kind, rng.choice([s for s in same if s != x.name]), x.args, x.value))


def hoist(n, rng, _):
    inner = [x for at, x in paths(n) if at and x.args]
    return rng.choice(inner) if inner else n


def param(n, rng, _):
    """A window changed by up to a fifth, within 2 to 60."""
    found = [(at, x) for at, x in paths(n) if x.kind == "ts"]
    if not found:
        return n
    at, x = rng.choice(found)
    w = int(x.args[-1].value)
    new = min(60, max(2, w + (rng.choice((-1, 1)) * max(1, round(w * 0.2 * rng.random())))))
    return replaced(n, at, Node(x.kind, x.name, (*x.args[:-1], number(new)), x.value))


def crossover(n, rng, other):
    at, _ = rng.choice(paths(n))
    return replaced(n, at, rng.choice(paths(other))[1])


def wrap_rank(n, rng, _):
    at, x = rng.choice(paths(n))
    return replaced(n, at, call("rank", x))


def add_ts_smoothing(n, rng, _):
    at, x = rng.choice(paths(n))
    return replaced(n, at, call(rng.choice(SMOOTH), x, number(rng.choice((3, 5, 10)))))


def add_condition(n, rng, _):
    return call("trade_when", parse(rng.choice(CONDITIONS)), n)


def add_volume_filter(n, rng, _):
    return call("trade_when", parse(f"volume > ts_mean(volume, {rng.choice((5, 10, 20))})"), n)


def combine_signals(n, rng, other):
    return Node("binary", "+", (call("rank", n), call("rank", other)))


def replace_subtree(n, rng, _):
    at, _x = rng.choice(paths(n))
    return replaced(n, at, random_tree(rng, 2))


def add_operator(n, rng, _):
    return Node("binary", rng.choice("+-*/"), (n, random_tree(rng, 2)))


MUTATIONS = {f.__name__: f for f in (point, hoist, param, crossover, wrap_rank, add_ts_smoothing, add_condition, add_volume_filter, combine_signals, replace_subtree, add_operator)}


def adapted(weights: dict[str, float], turnover: float, overfit: float, ic: float) -> dict[str, float]:
    """Mutation weights that answer a generation's metrics: high turnover asks for smoothing and filters, overfit for simpler trees, a weak IC for new material."""
    w = dict(weights)
    for bad, names in ((turnover > 100, ("add_ts_smoothing", "add_volume_filter", "param")), (overfit > 0.5, ("hoist", "param")), (abs(ic) < 0.01, ("replace_subtree", "crossover", "combine_signals"))):
        for k in names if bad else ():
            w[k] = w[k] * 1.5
    total = sum(max(v, 0.01) for v in w.values())
    return {k: max(v, 0.01) / total for k, v in w.items()}


def scale_free(n: Node) -> bool:
    """Whether a tree's values have no scale of prices or volumes, judged from the root: an operator gives scale-free values by itself, or hands on what its inputs have; a quotient by anything but a number may grow without bound."""
    if n.kind in ("number", "text") or n.name in SCALE_FREE:
        return True
    if n.kind == "field" or n.name == "/" and n.args[1].kind != "number":
        return False
    inputs = n.args[:-1] if n.kind == "ts" else n.args[:1] if n.kind in ("cs", "group") or n.name == "/" else n.args[1:] if n.name in ("if_else", "where", "trade_when") else n.args
    return all(map(scale_free, inputs))


def unstable_scale(n: Node) -> float:
    """Penalty for a tree whose values have the scale of prices or volumes."""
    return 0.0 if scale_free(n) else 0.15


def fitness(oos: float, turnover: float, drawdown: float, overfit_gap: float) -> float:
    return oos - 0.2 * turnover - 0.3 * abs(drawdown) - 0.5 * max(0.0, overfit_gap)


def evaluate(panel: DataFrame, expressions: list[str]) -> list[dict]:
    """ic, ic_ir, ir_is, ir_oos, overfit, turnover, fitness and print (mean signal by date) of each expression: one plan makes all signals, one more row a (alpha, ts, ticker) ranks them."""
    names = {f"s{i}": e for i, e in enumerate(expressions)}
    wide = signals(panel, names, keep=("ts", "ticker", "close") if "close" in panel.columns else ("ts", "ticker"))
    long = materialise(wide.unpivot(["ts", "ticker", "close"], list(names), "alpha_id", "signal"))
    segments = with_ratio_split(panel.select("ts").distinct())
    rows = {r.alpha_id: r.asDict() for r in quick_ic(long, ("alpha_id",), segments).collect()}
    # one number an expression and date
    prints = fingerprint(long).groupBy("alpha_id").agg(F.sort_array(F.collect_list(F.struct("ts", "level"))).alias("x"))
    levels = {r.alpha_id: [x.level for x in r.x] for r in prints.collect()}
    out = []
    for k, e in names.items():
        m = rows.get(k, {}) | {"dsl": e, "print": levels.get(k, [])}
        a, b = m.get("ir_is"), m.get("ir_oos")
        out.append(m | {"overfit": min(1.0, max(0.0, (a - b) / abs(a))) if a and b is not None else 0.0})
    return out


@dataclass
class Individual:
    tree: Node
    score: float = float("-inf")
    metrics: dict | None = None


def evolve(panel: DataFrame, generations: int = 2, size: int = 12, seed: int = 0, pool: AlphaPool | None = None, seeds: list[str] | None = None) -> tuple[list[Individual], AlphaPool]:
    """Seeds (of each family in turn), then per generation: evaluate all, keep the best quarter, fill up by tournaments of three and weighted mutations. The pool takes the alphas whose signals differ."""
    rng, pool = random.Random(seed), pool or AlphaPool()
    weights = {k: 1 / len(MUTATIONS) for k in MUTATIONS}
    start = seeds or [e for turn in zip_longest(*SEEDS.values()) for e in turn if e]
    people = [Individual(parse(e)) for e in start[:size]]
    while len(people) < size:
        people.append(Individual(random_tree(rng)))
    for g in range(generations + 1):
        found = evaluate(panel, [str(p.tree) for p in people])
        for p, m in zip(people, found, strict=True):
            p.metrics = m
            p.score = (m["fitness"] - unstable_scale(p.tree) - 0.5 * m["overfit"]) if m.get("fitness") is not None else float("-inf")
        people.sort(key=lambda p: (-p.score, str(p.tree)))
        for p in people:
            if p.score > float("-inf"):
                pool.add(str(p.tree), p.score, p.metrics["print"])
        if g == generations:
            break
        ok = [p.metrics for p in people if p.metrics.get("fitness") is not None]
        if ok:
            weights = adapted(weights, sum(m["turnover"] or 0 for m in ok) / len(ok), sum(m["overfit"] for m in ok) / len(ok), sum(m["ic"] or 0 for m in ok) / len(ok))
        new = [Individual(p.tree) for p in people[: max(1, size // 4)]]
        seen = {str(p.tree) for p in new}
        tries = 0
        while len(new) < size and tries < 50 * size:
            tries += 1
            pick = lambda: min(rng.sample(people, min(3, len(people))), key=lambda p: -p.score).tree
            name = rng.choices(list(weights), list(weights.values()))[0]
            child = MUTATIONS[name](pick(), rng, pick())
            try:
                validate(child, set(panel.columns))
            except ExpressionError:
                continue
            if str(child) not in seen:
                seen.add(str(child))
                new.append(Individual(child))
        people = new
    return people, pool


def _under_configs(panel: DataFrame, expression: str, configs: list[dict], keep: tuple[str, ...], keys=()) -> DataFrame:
    """(keys, keep, alpha_id, signal), alpha_id c0, c1, ... by config (delay, decay, q). A signal column per config: all share the exchange by date and the one by ticker."""
    spec = Window.partitionBy(*keys, "ticker").orderBy("ts")
    rows = signals(panel, expression, keys=keys, keep=keep)
    cut_at = {q: f"_q{i}" for i, q in enumerate(sorted({c["q"] for c in configs}))}
    for q, name in cut_at.items():
        rows = truncate(rows.withColumn("_s", F.col("signal")), q, 1 - q, keys).withColumnRenamed("signal", name).withColumnRenamed("_s", "signal")
    decayed = {k: f"_d{i}" for i, k in enumerate(sorted({(c["q"], c["decay"]) for c in configs}))}
    rows = rows.withColumns({name: ts_decay_linear(F.col(cut_at[q]), w, spec) if w > 1 else F.col(cut_at[q]) for (q, w), name in decayed.items()})
    rows = rows.withColumns({f"c{i}": F.lag(decayed[c["q"], c["decay"]], c["delay"]).over(spec) if c["delay"] else F.col(decayed[c["q"], c["decay"]]) for i, c in enumerate(configs)})
    return rows.unpivot([*keys, *keep], [f"c{i}" for i in range(len(configs))], "alpha_id", "signal")


def config_search(panel: DataFrame, expression: str, configs: list[dict]) -> DataFrame:
    """fitness of one expression under each of a list of (delay, decay, q) configs, all in one plan, one row a config."""
    table = panel.sparkSession.createDataFrame([(i, c["delay"], c["decay"], c["q"]) for i, c in enumerate(configs)], "config int, delay int, decay int, q double")
    rows = _under_configs(panel, expression, configs, ("ts", "ticker", "close")).withColumn("config", F.substring("alpha_id", 2, 9).cast("int")).drop("alpha_id")
    return quick_ic(rows, ("config",)).join(F.broadcast(table), "config")


def tune(panel: DataFrame, expression: str, trials: int = 16, seed: int = 0, modes: tuple[str, ...] = ("long_short", "decile"), late: float = 0.4) -> list[dict]:
    """Seeded search over delay, decay, truncation and mode by the fitness of in-sample dates, best first; the last `late` of them, run apart, stand for what is out of sample. panel holds in-sample dates only.

    Half of the trials are drawn at random, the others around the better third so far. A batch of trials is one plan with a key per trial.
    """
    rng, done = random.Random(seed), []
    fresh = lambda: {"delay": rng.randint(0, 3), "decay": rng.randint(0, 8), "q": round(rng.uniform(0.0, 0.1), 3), "mode": rng.choice(modes)}

    def near(c: dict) -> dict:
        new = {"delay": min(3, max(0, c["delay"] + rng.randint(-1, 1))), "decay": min(8, max(0, c["decay"] + rng.randint(-2, 2))), "q": round(min(0.1, max(0.0, c["q"] + rng.gauss(0, 0.02))), 3)}
        return new | {"mode": c["mode"] if rng.random() < 0.8 else rng.choice(modes)}

    axis = ordered_axis(panel)
    n = axis.count()
    parts = axis.select("ts", F.explode(F.when(F.col("i") >= int(n * (1 - late)), F.array(F.lit("full"), F.lit("late"))).otherwise(F.array(F.lit("full")))).alias("segment"))
    split = panel.join(F.broadcast(parts), "ts")
    for batch in (trials - trials // 2, trials // 2):
        if not batch:
            continue
        good = sorted(done, key=lambda x: -x["fitness"])[: max(1, len(done) // 3)]
        configs = [near(rng.choice(good)) if good else fresh() for _ in range(batch)]
        rows = _under_configs(split, expression, configs, realistic.KEEP, ("segment",))
        made = None
        for mode in sorted({c["mode"] for c in configs}):
            of = rows.where(F.col("alpha_id").isin([f"c{i}" for i, c in enumerate(configs) if c["mode"] == mode]))
            one = realistic.construct(of, SignalConfig(mode=mode)).select(*realistic.KEYS, "ts", "ticker", "close", "weight", "adv")
            made = one if made is None else made.unionByName(one)
        _, day = realistic.results(made)
        series = day.select(*realistic.KEYS, "ts", F.col("net").alias("r"))
        found = summary(series, realistic.KEYS).join(max_drawdown(series, realistic.KEYS).select(*realistic.KEYS, "mdd"), [*realistic.KEYS]).join(turnover_analysis(day, realistic.KEYS), [*realistic.KEYS])
        got = {(r.alpha_id, r.segment): r for r in found.collect()}
        for i, c in enumerate(configs):
            whole, end = got.get((f"c{i}", "full")), got.get((f"c{i}", "late"))
            if whole is None or whole.sharpe is None:
                continue
            a = whole.sharpe
            b = end.sharpe if end is not None and end.sharpe is not None else a
            done.append(c | {"sharpe": a, "sharpe_late": b, "fitness": fitness(b, whole.ann_turnover, whole.mdd, (a - b) / abs(a) if a else 0.0)})
    return sorted(done, key=lambda x: (-x["fitness"], str(x)))


def features(n: Node) -> list[float]:
    """What a surrogate sees of a tree: sizes, counts by kind, windows."""
    nodes = list(n.walk())
    windows = [x.args[-1].value for x in nodes if x.kind == "ts"]
    kinds = [sum(x.kind == k for x in nodes) for k in ("ts", "cs", "group", "scalar", "binary", "unary", "field", "number")]
    used = [float(f in n.fields()) for f in FIELDS]
    return [float(len(nodes)), float(n.depth()), *map(float, kinds), max(windows, default=0.0), min(windows, default=0.0), *used]


def surrogate(spark, samples: list[tuple[str, bool]], least: int = 50):
    """A function from an expression to the chance that it is poor: boosted trees once there are `least` samples of both kinds, a depth rule before."""
    if len(samples) < least or len({bad for _, bad in samples}) < 2:
        return lambda e: 0.9 if parse(e).depth() > 8 else 0.3
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense(features(parse(e))), float(bad)) for e, bad in samples], ["features", "label"])
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=1).fit(rows)
    return lambda e: float(model.predictProbability(Vectors.dense(features(parse(e))))[1])


def family(n: Node) -> str:
    """Factor family of a tree, by the operators and fields in it: composite where several show."""
    names = {x.name for x in n.walk()}
    found = [f for f, ops in MARKS.items() if names & ops]
    if "volume" in names and ("ts_corr" in names or "momentum" not in found):
        found.append("price_volume_corr" if "ts_corr" in names else "liquidity")
    if len(found) > 1:
        return "composite"
    if found == ["momentum"]:
        if any(x.kind == "unary" and x.name == "-" and {"ts_delta", "ts_rank"} & {y.name for y in x.walk()} for x in n.walk()):
            return "reversion"
        return "trend_following" if max((x.args[-1].value for x in n.walk() if x.kind == "ts"), default=0) >= 60 else "momentum"
    return found[0] if found else "reversion" if "ts_zscore" in names else "trend_following" if "ts_mean" in names and "ts_corr" not in names else "momentum"


def interpret(expression: str) -> dict:
    """Family, complexity and issues of an expression."""
    n = parse(expression)
    names = {x.name for x in n.walk()}
    issues = [m for bad, m in ((n.depth() > 8, "deep"), (len(list(n.walk())) > 40, "large"), (unstable_scale(n) > 0, "not scale-free"), (not names & {"rank", "zscore", "scale", "normalize", "demean"}, "no cross-section")) if bad]
    return {"family": family(n), "type": n.result_type(), "nodes": len(list(n.walk())), "depth": n.depth(), "issues": issues}


def diagnose(metrics: DataFrame) -> DataFrame:
    """diagnosis and severity of rows (sharpe_is, sharpe_oos, turnover, mean_ic, ic_ir, mdd, overfit): the first finding that holds, in the order below."""
    c = F.col
    #: Findings with their thresholds.
    rules = [
        ("severe_overfitting", (c("overfit") > 0.6) & (c("sharpe_is") > 0.8), F.lit("critical")),
        ("high_turnover", c("turnover") > 3.0, F.when(c("turnover") > 5.0, "critical").otherwise("moderate")),
        ("no_signal", (c("sharpe_oos") < 0.1) & (c("mean_ic") < 0.01), F.lit("critical")),
        ("noisy_signal", (c("mean_ic") > 0.02) & (c("ic_ir") < 0.3), F.lit("moderate")),
        ("high_drawdown", F.abs("mdd") > 0.25, F.lit("moderate")),
        ("mild_overfitting", (c("overfit") > 0.1) & (c("overfit") <= 0.6) & (c("sharpe_is") > c("sharpe_oos") + 0.3), F.lit("moderate")),
        ("healthy", (c("sharpe_oos") > 0.5) & (c("overfit") < 0.3), F.lit("minor")),
    ]
    name, severity = F.lit("weak_alpha"), F.lit("moderate")
    for what, holds, how in reversed(rules):
        name, severity = F.when(holds, what).otherwise(name), F.when(holds, how).otherwise(severity)
    return metrics.withColumns({"diagnosis": name, "severity": severity})
