"""URL filters: fixed rules first, then empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad 0 or 1) are counted per host and shrunk level by level: all pages -> suffix -> registered domain -> host. At each level the prior is a beta distribution around the parent's posterior mean, whose strength the method of moments estimates from the spread of the level's own rates. A host is blocked when the lower bound of its posterior bad rate exceeds a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, join_groups

#: (rule, verdict): a host, then a path that the url's path must start with.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
BLOCK_RATE = 0.3  # bad rate that a host's lower bound must exceed
Z = 1.645  # one-sided 95 %
#: Labels under which country registries register names.
SECOND = "ac co com edu go gob gouv gov mil ne net nom or org sch".split()
SECOND_LEVEL = rf"^({'|'.join(SECOND)})\.[a-z][a-z]$"
STRENGTHS = (1.0, 200.0)  # least and most pseudo-counts of a prior


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract states: both empty without '://'."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first in text order) and its verdict; null, null if none does. The rules are a fixed list, so they are one CASE expression, not a join."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _level(counts: DataFrame, key: str, parent: str, prior: DataFrame) -> DataFrame:
    """(key, mean, weight, seen_n, strength): posterior mean and pseudo-counts of each key, its prior the parent's mean (prior has parent, mean). The strength comes from the variance of all keys' rates around their priors beyond the binomial one."""
    rows = counts.groupBy(key, parent).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(prior.select(F.col(parent), F.col("mean").alias("m0")), parent)
    moments = rows.where("n > 1").agg(
        F.sum((F.col("bad") - F.col("n") * F.col("m0")) ** 2).alias("seen"),
        F.sum(F.col("n") * F.col("m0") * (1 - F.col("m0"))).alias("noise"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col("m0") * (1 - F.col("m0"))).alias("spread"),
    )
    # Var(bad) = noise + rho * spread with rho = 1 / (strength + 1)
    rho = F.try_divide(F.col("seen") - F.col("noise"), F.col("spread"))
    strength = F.coalesce(F.when(rho > 0, F.try_divide(F.lit(1.0), rho) - 1).when(rho <= 0, F.lit(STRENGTHS[1])), F.lit(STRENGTHS[0]))
    one = moments.select(F.least(F.lit(STRENGTHS[1]), F.greatest(F.lit(STRENGTHS[0]), strength)).alias("s"))
    return rows.join(F.broadcast(one)).select(key, ((F.col("bad") + F.col("s") * F.col("m0")) / (F.col("n") + F.col("s"))).alias("mean"), (F.col("n") + F.col("s")).alias("weight"), F.col("n").alias("seen_n"), F.col("s").alias("strength"))


def _domain_suffix(host: Column) -> dict[str, Column]:
    """suffix: the last label, or the last two where they are a second-level label of SECOND under a country's; registered domain: one label more. The port is left out; an IPv4 address is its own domain, of the suffix '(address)'."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    two = F.substring_index(name, ".", -2).rlike(SECOND_LEVEL)
    suffix = F.when(address, "(address)").when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return {"domain": domain, "suffix": suffix}


def _lower(mean: Column, weight: Column) -> Column:
    return F.greatest(F.lit(0.0), mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1)))


def _levels(outcomes: DataFrame) -> dict[str, DataFrame]:
    """The posteriors by level: root, suffix, domain, host."""
    counts = cut(outcomes.where("bad IS NOT NULL AND host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")).withColumns({**_domain_suffix(F.col("host")), "root": F.lit("")}))
    levels = {"root": counts.groupBy("root").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("mean"))}
    for key, parent in (("suffix", "root"), ("domain", "suffix"), ("host", "domain")):
        levels[key] = cut(_level(counts, key, parent, levels[parent]))
    return levels


def _own(levels: dict[str, DataFrame]) -> DataFrame:
    return levels["host"].select("host", F.col("seen_n").alias("n"), "mean", _lower(F.col("mean"), F.col("weight")).alias("lower"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: (host, bad) with bad 0 or 1. One row a host that has outcomes: host, n, mean and lower (bound of its posterior bad rate).

    Registered domain and suffix are those of _domain_suffix. Null outcomes and empty hosts are left out. Only sums per host go on, so a host with a third of all pages costs no more than another.
    """
    return _own(_levels(outcomes))


def _inherited(hosts: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """(host, inherited) of hosts (host, distinct) without outcomes: the bound of the prior that the nearest known parent gives, its mean with the strength of the level below it. No outcomes at all give null."""
    rows = hosts.where("host <> ''").join(levels["host"].select("host"), "host", "left_anti").withColumns(_domain_suffix(F.col("host")))
    mean = weight = F.lit(None).cast("double")
    for parent, child in (("root", "suffix"), ("suffix", "domain"), ("domain", "host")):
        strength = levels[child].agg(F.max("strength").alias(f"{parent}_s"))
        known = levels[parent].select(F.col(parent), F.col("mean").alias(f"{parent}_mean"))
        rows = rows.crossJoin(F.broadcast(strength))
        rows = rows.crossJoin(F.broadcast(known.drop("root").agg(F.max("root_mean").alias("root_mean")))) if parent == "root" else rows.join(known, parent, "left")
        here = F.col(f"{parent}_mean")
        mean, weight = F.coalesce(here, mean), F.when(here.isNotNull(), F.col(f"{parent}_s")).otherwise(weight)
    return rows.select("host", F.when(mean.isNotNull(), _lower(mean, weight)).alias("inherited"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, block_rate: float = BLOCK_RATE) -> DataFrame:
    """Judges each row of pages (page_id, url): page_id, host, path, rule, verdict, bad_rate_lower.

    outcomes: (page_id, bad). A rule decides where one fits; else the host is blocked when its lower bound exceeds block_rate; a host without outcomes has bad_rate_lower null and is judged by the bound that its registered domain, else its suffix, else all pages give as its prior. Without any outcomes all such hosts are allowed. A null url, or one without '://', has empty host and path, fits no rule and is allowed. Rows that repeat are judged each; an outcome that is given twice counts once, as bad if one of them is; a page that is given twice with one host counts once, and null page ids have no outcome.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    once = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = rows.select("page_id", "host").distinct().join(once, "page_id")
    levels = _levels(seen)
    hosts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("size")))
    known = _own(levels).select("host", F.col("lower").alias("bad_rate_lower"), F.col("lower").alias("bound"))
    reputation = known.unionByName(_inherited(hosts.select("host"), levels).select("host", F.lit(None).cast("double").alias("bad_rate_lower"), F.col("inherited").alias("bound")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    sized = cut(hosts.join(reputation, "host"))
    rows = join_groups(rows, sized, ["host"], hosts.agg(F.sum("size")).first()[0] or 0, how="left").withColumns({"rule": rule, "by_rule": verdict})
    own = F.when(F.coalesce(F.col("bound") > block_rate, F.lit(False)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), F.round("bad_rate_lower", 6).alias("bad_rate_lower"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes: a page is bad when the label row of its number marks low quality or toxicity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes)


def _sql_level(name: str, key: str, parent: str, prior: str) -> str:
    return f"""
{name}_rows AS (SELECT c.{key}, sum(n) AS n, sum(bad) AS bad, any_value(p.mean) AS m0 FROM counts c JOIN {prior} p USING ({parent}) GROUP BY c.{key}, c.{parent}),
{name}_s AS (SELECT sum((bad - n * m0) * (bad - n * m0)) AS seen, sum(n * m0 * (1 - m0)) AS noise, sum(n * (n - 1) * m0 * (1 - m0)) AS spread FROM {name}_rows WHERE n > 1),
{name}_t AS (SELECT least({STRENGTHS[1]}, greatest({STRENGTHS[0]}, coalesce(CASE WHEN spread = 0 THEN NULL WHEN (seen - noise) / spread > 0 THEN spread / (seen - noise) - 1 ELSE {STRENGTHS[1]} END, {STRENGTHS[0]}))) AS s FROM {name}_s),
{name} AS (SELECT {key}, (bad + s * m0) / (n + s) AS mean, n + s AS weight FROM {name}_rows, {name}_t)"""


_LABELS = "array_to_string(list_slice(string_split(name, '.'), -{}, -1), '.')"
_HOSTS = f"""SELECT host, CASE WHEN addr THEN name WHEN two THEN {_LABELS.format(3)} ELSE {_LABELS.format(2)} END AS domain, CASE WHEN addr THEN '(address)' WHEN two THEN {_LABELS.format(2)} ELSE {_LABELS.format(1)} END AS suffix, '' AS root
FROM (SELECT *, regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') AS addr, regexp_matches({_LABELS.format(2)}, '{SECOND_LEVEL}') AS two FROM (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM p))"""
_BOUND = f"greatest(0.0, mean - {Z} * sqrt(mean * (1 - mean) / (weight + 1)))"

OP2_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hosts AS ({_HOSTS}),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 ELSE 0.0 END) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, '' AS root, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM (SELECT DISTINCT page_id, host FROM p) JOIN outcomes USING (page_id) JOIN hosts USING (host) WHERE host <> '' GROUP BY host),
r0 AS (SELECT root, (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM counts GROUP BY root),
{_sql_level("r1", "suffix", "root", "r0")},
{_sql_level("r2", "domain", "suffix", "r1")},
{_sql_level("r3", "host", "domain", "r2")},
rep AS (SELECT host, {_BOUND} AS lower FROM r3),
inh AS (SELECT host, {_BOUND} AS inherited FROM (SELECT h.host, coalesce(r2.mean, r1.mean, r0.mean) AS mean, CASE WHEN r2.mean IS NOT NULL THEN (SELECT s FROM r3_t) WHEN r1.mean IS NOT NULL THEN (SELECT s FROM r2_t) ELSE (SELECT s FROM r1_t) END AS weight FROM hosts h LEFT JOIN r2 ON h.domain = r2.domain LEFT JOIN r1 ON h.suffix = r1.suffix LEFT JOIN r0 ON h.root = r0.root WHERE h.host <> '')),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in RULES)}) AS x(rule, verdict, rhost, rpath)),
fit AS (SELECT DISTINCT host, path, first_value(rule) OVER w AS rule, first_value(verdict) OVER w AS verdict FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) WINDOW w AS (PARTITION BY host, path ORDER BY length(rule) DESC, rule))
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN coalesce(lower, inherited) > {BLOCK_RATE} THEN 'block' ELSE 'allow' END) AS verdict, round(lower, 6) AS bad_rate_lower
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN rep ON p.host = rep.host LEFT JOIN inh ON p.host = inh.host
"""
