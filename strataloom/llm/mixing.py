"""Mixing sources to target weights by iterative proportional fitting.

A document's topic is the nearest of a few centres of word counts of its language, learned by spherical k-means from all documents. Token counts are summed per cell (source, language, topic). The cells' sampling probabilities are raked to the target share of each source, language and topic in turn, bounded by 1, until the margins hold; each document is then drawn by its cell's probability with a hash of its id, so a draw can be repeated.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .shared import cut, drop_cut

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}  # target share of a value: its tokens to this power
BUDGET = 0.5  # tokens to draw, as a share of all
TOPICS = 8
RARE = 200  # a language with less than this part of the rows has no topics of its own
ROUNDS_OF_TOPICS, SETTLED = 25, 1e-4
SEEDS, DRAWS = 32, 3  # rows that a draw takes on average, to begin the means from
DIMS = 512  # of a document's vector
VECTORS_HELD = 2048
CELLS_ON_DRIVER = 100_000  # more cells are raked by DataFrame operations
ROUNDS, TOLERANCE = 200, 1e-9
SEED = 17


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, unit vectors) of texts: the square roots of the counts of their words of four or more bytes, hashed to DIMS places; 0 without such words."""
    n_docs = len(offsets) - 1
    starts, ends, doc = vec.words(data, offsets)
    n = np.bincount(doc, minlength=n_docs)
    long = ends - starts >= 4
    h = (vec.mix(vec.word_hashes(data, starts[long], ends[long]), 51) % vec.U(DIMS)).astype(np.int64)
    x = np.sqrt(np.bincount(doc[long] * DIMS + h, minlength=n_docs * DIMS)).reshape(n_docs, DIMS)
    return n, x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _slices(batches):
    """Slices of texts of about 1 MiB, of VECTORS_HELD rows at most."""
    for part, data, offsets in vec.pieces(batches):
        for i in range(0, part.num_rows, VECTORS_HELD):
            j = min(i + VECTORS_HELD, part.num_rows)
            yield part.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _vectors(batches):
    """(order, lang, x) of each text that has words to tell a topic by."""
    import pyarrow as pa

    for part, data, offsets in _slices(batches):
        x = vectors(data, offsets)[1].astype(np.float32)
        some = np.flatnonzero(x.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(some)) for c in ("order", "lang")), pa.array([r.tobytes() for r in x[some]], pa.binary())], names=["order", "lang", "x"])


def _by_language(batches, own: set):
    """(name, orders, vectors) of the rows of each language of `own` in a batch, and of all its rows by the name None."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = vec.string_buffers(batch.column("x"))
        x = data[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, DIMS)
        order = batch.column("order").to_numpy().view(vec.U)
        lang = batch.column("lang").dictionary_encode()
        code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        yield None, order, x
        for i, name in enumerate(names):
            if name in own:
                yield name, order[code == i], x[code == i]


def _far(x: np.ndarray, c: np.ndarray | None) -> np.ndarray:
    """Squared distances from the nearest of the centres, as integers in units of 2 ** -20; 1 without centres."""
    far = np.ones(len(x)) if c is None else np.maximum(1 - (x @ c.T).max(axis=1), 0) ** 2
    return np.rint(far * (1 << 20)).astype(np.int64)


def _weights(own: set, centres: dict):
    """Of each name the sum of _far."""

    def run(batches):
        import pyarrow as pa

        sums = Counter()
        for name, _, x in _by_language(batches, own):
            sums[name] += int(_far(x, centres.get(name)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["name", "w"])

    return run


def _draw(own: set, centres: dict, total: dict, turn: int):
    """Of each name about SEEDS rows, each drawn by its part of the sum of _far, by a hash of the row, so that a draw does not depend on how rows are dealt out."""

    def run(batches):
        import pyarrow as pa

        for name, order, x in _by_language(batches, own):
            u = (vec.mix(order, 61 + turn) >> vec.U(11)).astype(np.float64) / 2.0**53
            at = np.flatnonzero(u * total.get(name, 0) < SEEDS * _far(x, centres.get(name)).astype(float))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(order[at].view(np.int64)), pa.array([r.tobytes() for r in x[at]], pa.binary())], names=["name", "order", "x"])

    return run


def cluster(x: np.ndarray, weight: np.ndarray, k: int, tries: int = 20, rounds: int = 25) -> np.ndarray:
    """Centres (unit vectors) of k topics of weighted rows by spherical k-means, the best of some tries; fewer where there are not k different rows."""
    rng, best, most = np.random.default_rng(SEED), x[:0], -1.0
    for _ in range(tries if len(x) else 0):
        c = x[[rng.choice(len(x), p=weight / weight.sum())]]
        while len(c) < k:
            far = np.maximum(1 - (x @ c.T).max(axis=1), 0) ** 2 * weight
            if far.sum() < 1e-9:
                break
            c = np.concatenate([c, x[[rng.choice(len(x), p=far / far.sum())]]])
        for _ in range(rounds):
            of = (x @ c.T).argmax(axis=1)
            new = np.array([(x[of == i] * weight[of == i, None]).sum(axis=0) if (weight[of == i] > 0).any() else c[i] for i in range(len(c))])
            new /= np.sqrt((new * new).sum(axis=1, keepdims=True))
            if np.allclose(new, c, atol=1e-9):
                break
            c = new
        good = float(((x @ c.T).max(axis=1) * weight).sum())
        if good > most + 1e-9:
            best, most = c, good
    return best


def _nearest(own: set, centres: dict):
    """Of each name and centre the rows that are nearest to it: their number and the sum of their vectors in units of 2 ** -20, as integers, so that the order of addition does not matter."""

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for name, _, x in _by_language(batches, own):
            if (c := centres.get(name)) is None:
                continue
            here = (x @ c.T).argmax(axis=1)[:, None] == np.arange(len(c))
            n, total = sums.get(name, (0, 0))
            sums[name] = n + here.sum(axis=0), total + here.T.astype(np.float64) @ np.rint(x * np.float64(1 << 20))
        out = [(name, i, int(n[i]), total[i].astype(np.int64).tobytes()) for name, (n, total) in sums.items() for i in range(len(n)) if n[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["name", "centre", "n", "total"])

    return run


def _added(batches):
    """Rows of _nearest with those of one name and centre as one."""
    import pyarrow as pa

    sums: dict = {}
    for batch in batches:
        for name, i, n, total in zip(*(batch.column(c).to_pylist() for c in ("name", "centre", "n", "total")), strict=True):
            m, so_far = sums.get((name, i), (0, 0))
            sums[name, i] = m + n, so_far + np.frombuffer(total, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["name", "centre", "n", "total"])


def learn_topics(docs: DataFrame, topics: int = TOPICS, sample: int | None = None, rounds: int = ROUNDS_OF_TOPICS) -> dict[str, np.ndarray]:
    """Topic centres (unit vectors) of each language, the topic with most documents first, by spherical k-means over all rows of docs (doc_id, text, lang) that have words; under '' those of all languages together, for languages that have less than 1 / RARE of the rows or are not in docs. A language has fewer topics where it has not as many different rows. With `sample`, only about so many rows are learned from, the first by a hash of id and text.

    Topics are learned within a language, since words tell the language first, and its share is a margin of its own. The vectors are written to the shared folder once. In DRAWS passes about SEEDS rows each are drawn from all by their squared distance from those drawn before (k-means||), whose clusters are what the means begin from; each round of means is a pass over all rows, for all languages at once, until no coordinate moves by SETTLED or for `rounds` rounds. To the driver come one row a centre and the drawn rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64("doc_id", text, F.lit(SEED)).alias("order"), F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("lang"), text.alias("text"))
    if sample is not None:
        rows = rows.where(F.col("order") <= F.coalesce(F.lit(rows.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]), F.lit(0)))
    rows = cut(rows.mapInArrow(_vectors, "order long, lang string, x binary"))
    n = rows.count()
    own = {r.lang for r in rows.groupBy("lang").count().where(F.col("count") * RARE >= n).collect()}
    centres: dict = {}
    for turn in range(DRAWS if n else 0):
        total = {r.name: r.w for r in rows.mapInArrow(_weights(own, centres), "name string, w long").groupBy("name").agg(F.sum("w").alias("w")).collect()}
        found: dict = {}
        for r in rows.mapInArrow(_draw(own, centres, total, turn), "name string, order long, x binary").distinct().collect():
            found.setdefault(r.name, []).append((r.order, r.x))
        for name, some in found.items():
            more = np.stack([np.frombuffer(x, np.float32) for _, x in sorted(some)]).astype(float)
            centres[name] = np.concatenate([centres[name], more]) if name in centres else more

    def assigned():
        sums = rows.mapInArrow(_nearest(own, centres), "name string, centre int, n long, total binary")
        return sums.repartition("name", "centre").mapInArrow(_added, "name string, centre int, n long, total binary").collect()

    # the drawn rows, each with the number of rows that it is nearest to, stand for all rows where the k-means begins
    size = {(r.name, r.centre): r.n for r in assigned()} if n else {}
    centres = {name: cluster(c, np.array([size.get((name, i), 0) for i in range(len(c))], float), topics) for name, c in centres.items()}
    for _ in range(rounds if n else 0):
        new = {name: c.copy() for name, c in centres.items()}
        for r in assigned():
            total = np.frombuffer(r.total, np.int64).astype(float)
            new[r.name][r.centre] = total / np.sqrt((total * total).sum())
        settled = all(np.allclose(new[name], c, rtol=0, atol=SETTLED) for name, c in centres.items())
        centres = new
        if settled:
            break
    size = {(r.name, r.centre): r.n for r in assigned()} if n else {}
    drop_cut(rows)
    every = {"": np.zeros((0, DIMS))}
    for name, c in sorted(centres.items(), key=lambda x: (x[0] is not None, x[0] or "")):
        every[name or ""] = c[np.argsort([-size.get((name, i), 0) for i in range(len(c))], kind="stable")]
    return every


def _topics(centres: dict[str, np.ndarray]):
    """(id, source, lang, tokens, topic): tokens are words; the topic is the one of its language whose centre is nearest (ties: the lowest), -1 without words to tell it by."""

    def run(batches):
        import pyarrow as pa

        for part, data, offsets in _slices(batches):
            n, x = vectors(data, offsets)
            topic, lang = np.full(part.num_rows, -1), np.array(part.column("lang").to_pylist(), object)
            for name in set(lang):
                c = centres.get(name, centres[""])
                here = (lang == name) & x.any(axis=1)
                if len(c):
                    topic[here] = (x[here] @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(n.astype(np.int64)), pa.array(topic.astype(np.int32))], names=["doc_id", "source", "lang", "n_tokens", "topic"])

    return run


def describe(docs: DataFrame, centres: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, source, lang (null as '(none)'), n_tokens, topic of each row of docs (doc_id, text, source, lang); topics are learned from docs where no centres are given."""
    centres = learn_topics(docs) if centres is None else centres
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *named).mapInArrow(_topics(centres), "doc_id long, source string, lang string, n_tokens long, topic int")


def _target(total, temper: float):
    return total**temper if temper else (total > 0) * 1.0


def rake_local(cells: list[tuple], budget: float, temper: dict) -> list[float]:
    """Probabilities of cells (source, lang, topic, tokens): see rake."""
    tokens = np.array([c[3] for c in cells], float)
    codes = [np.unique([str(c[i]) for c in cells], return_inverse=True)[1] for i in range(3)]
    want = []
    for code, name in zip(codes, MARGINS, strict=True):
        t = _target(np.bincount(code, weights=tokens), temper[name])
        want.append(t / t.sum() * budget * tokens.sum())
    p = np.full(len(cells), budget)
    for _ in range(ROUNDS):
        was = p.copy()
        for code, w in zip(codes, want, strict=True):
            have = np.bincount(code, weights=p * tokens)
            p = p * np.where(have > 0, w / np.where(have > 0, have, 1), 1)[code]
        p = np.minimum(p, 1)
        if np.abs(p - was).max() < TOLERANCE:
            break
    return p.tolist()


def rake_frames(cells: DataFrame, budget: float, temper: dict, rounds: int | None = None) -> DataFrame:
    """The same by DataFrame operations, for any number of cells, by the same targets, rounds and tolerance: a round is three sums and joins, cut to the shared folder."""
    total = cells.agg(F.sum("tokens")).first()[0]
    want = {}
    for name in MARGINS:
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("t")).withColumn("w", F.pow("t", F.lit(float(temper[name]))) if temper[name] else (F.col("t") > 0).cast("double"))
        scale = sums.agg(F.sum("w")).first()[0]
        want[name] = cut(sums.select(name, (F.col("w") / scale * (budget * total)).alias("w")))
    state = cut(cells.withColumn("prob", F.lit(float(budget))))
    for _ in range(ROUNDS if rounds is None else rounds):
        new = state.withColumn("was", F.col("prob"))
        for name in MARGINS:
            have = new.groupBy(name).agg(F.sum(F.col("prob") * F.col("tokens")).alias("have"))
            factor = have.join(want[name], name).select(name, F.when(F.col("have") > 0, F.col("w") / F.col("have")).otherwise(1.0).alias("f"))
            new = new.join(factor, name).withColumn("prob", F.col("prob") * F.col("f")).drop("f")
        new = cut(new.withColumn("prob", F.least("prob", F.lit(1.0))))
        drop_cut(state)
        moved = new.agg(F.max(F.abs(F.col("prob") - F.col("was")))).first()[0]
        state = new.drop("was")
        if moved < TOLERANCE:
            break
    return state


def rake(cells: DataFrame, budget: float = BUDGET, temper: dict = TEMPER) -> DataFrame:
    """cells (source, lang, topic, tokens) with prob: the probabilities, at most 1, whose expected tokens have the target share per source, language and topic and add up to budget times all tokens. Where bounds or missing cells make that impossible, the last rake (topic) holds best. Cells without tokens keep the budget's probability."""
    cells = cut(cells)
    spark = cells.sparkSession
    n, tokens = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n or not tokens:
        return cells.withColumn("prob", F.lit(float(budget)))
    if n > CELLS_ON_DRIVER:
        return rake_frames(cells, budget, temper)
    rows = sorted((r.source, r.lang, r.topic, r.tokens) for r in cells.collect())
    return spark.createDataFrame([(*r, p) for r, p in zip(rows, rake_local(rows, budget, temper), strict=True)], "source string, lang string, topic int, tokens long, prob double")


def drawn(id_col, prob):
    """Whether a document is drawn: the hash of its id, as a number from 0 to 1, is below its probability."""
    return F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52)) < prob


def mix(docs: DataFrame, budget: float = BUDGET, temper: dict = TEMPER) -> DataFrame:
    """One row per row of docs (doc_id, text, source, lang): doc_id, source, lang, topic, n_tokens, prob, sampled.

    Null sources and languages are values of their own; null and empty texts have 0 tokens and topic -1; rows that repeat an id are drawn together, and rows without an id likewise; an empty table gives an empty result. Other columns are not read.
    """
    rows = cut(describe(docs))
    cells = rake(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), budget, temper).select(*MARGINS, "prob")
    if cells.count() <= CELLS_ON_DRIVER:
        cells = F.broadcast(cells)
    out = rows.join(cells, [*MARGINS])
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 9).alias("prob"), drawn(F.col("doc_id"), F.col("prob")).alias("sampled"))


def margin_report(mixed: DataFrame, budget: float = BUDGET, temper: dict = TEMPER) -> DataFrame:
    """Of mix()'s rows, per margin and value: its target tokens, the expected ones (probability times tokens), those drawn, and the residual (expected less target, as a share of the target). Targets that bounds or missing cells put out of reach show here."""
    out = None
    for name in MARGINS:
        sums = mixed.groupBy(F.col(name).cast("string").alias("value")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("prob") * F.col("n_tokens")).alias("expected"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("drawn"))
        weight = F.pow("tokens", F.lit(float(temper[name]))) if temper[name] else (F.col("tokens") > 0).cast("double")
        every = sums.agg(F.sum("tokens").alias("all_tokens"), F.sum(weight).alias("all_weight"))
        target = F.try_divide(weight, F.col("all_weight")) * budget * F.col("all_tokens")
        one = sums.crossJoin(F.broadcast(every)).select(F.lit(name).alias("margin"), "value", target.alias("target"), "expected", "drawn", F.try_divide(F.col("expected") - target, target).alias("residual"))
        out = one if out is None else out.unionByName(one)
    return out


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
