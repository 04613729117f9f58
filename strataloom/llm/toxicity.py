"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs, trained here in numpy.

A word is the sum of two inputs side by side: a hashed word vector, and the mean of the vectors of its hashed character strings (with marks for its start and end). Windows of WINDOW words overlap by half; every window of a text is scored, and the text's score is that of its worst window. Training sees only a bounded sample of labelled rows; since a label marks a text and not a place, the first passes take windows of toxic texts at random and the later ones the windows that the network finds worst, in toxic and in clean texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec

WINDOW, STEP = 32, 16
WORD_ROWS = CHAR_ROWS = 8192
DIM, HIDDEN, ATTENTION = 8, 8, 8
TRAIN_TOXIC, TRAIN_CLEAN = 800, 1200  # labelled rows that training sees, at most
TRAIN_BYTES = 16 << 20  # of their texts together; a row is taken whole or, where it does not fit any more, not at all
BATCH, WARM_STEPS, HARD_STEPS = 384, 60, 60
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_types(data: np.ndarray, offsets: np.ndarray):
    """Words of texts: (document of each word, its type, word rows, character rows and their type): types are the distinct words, A-Z lower-cased, signs cut off both ends."""
    starts, ends, doc = vec.words(data, offsets)
    starts, ends = vec.trimmed(starts, ends, ~_SIGN[data])
    ends = np.maximum(ends, starts + 1)  # a word of signs only: its first one
    low = vec.LOWER[data]
    h, first, kind = np.unique(vec.span_hash(low, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    parts, owner = [], []
    for n in (2, 3, 4):  # inner strings; those at the start and at the end also by that place
        count = np.maximum(e - s - n + 1, 0)
        own = np.repeat(np.arange(len(h)), count)
        at = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        g = vec.short_grams(low, at, n)
        if n > 2:
            parts.append(g)
            owner.append(own)
        opens, closes = at == s[own], at + n == e[own]
        parts += [vec.mix(g[opens], 21), vec.mix(g[closes], 22)]
        owner += [own[opens], own[closes]]
    word_row = (vec.mix(h, 31) % vec.U(WORD_ROWS)).astype(np.int64)
    char_row = (vec.mix(np.concatenate(parts), 32) % vec.U(CHAR_ROWS)).astype(np.int64)
    return doc, kind, word_row, char_row, np.concatenate(owner)


def window_table(doc: np.ndarray, n_docs: int):
    """(document, first word, words) of each window; documents without words have none."""
    count = np.bincount(doc, minlength=n_docs)
    n = np.where(count > 0, 1 + np.maximum(-(-(count - WINDOW) // STEP), 0), 0)
    owner = np.repeat(np.arange(n_docs), n)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    first = (np.cumsum(count) - count)[owner] + place
    return owner, first, np.minimum(count[owner] - place, WINDOW)


def fresh(seed: int = 5) -> dict:
    r = np.random.default_rng(seed)
    init = lambda *s, k=1.0: (r.standard_normal(s) * k / np.sqrt(s[0])).astype(np.float32)
    p = {"word": (r.standard_normal((WORD_ROWS, DIM)) * 0.1).astype(np.float32), "char": (r.standard_normal((CHAR_ROWS, DIM)) * 0.5).astype(np.float32)}
    for d in "fb":
        p |= {f"x{d}": init(3 * HIDDEN, 2 * DIM).T.copy() * np.float32(1.2), f"u{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"att": init(2 * HIDDEN, ATTENTION), "query": init(ATTENTION), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}


def inputs(p: dict, word_row, char_row, owner) -> np.ndarray:
    """Input vector of each type."""
    count = np.maximum(np.bincount(owner, minlength=len(word_row)), 1).astype(np.float32)
    chars = np.stack([np.bincount(owner, weights=p["char"][char_row, j], minlength=len(word_row)) for j in range(DIM)], axis=1)
    return np.concatenate([p["word"][word_row], (chars / np.sqrt(count)[:, None]).astype(np.float32)], axis=1)


def _sigmoid(x):
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def projected(p: dict, x: np.ndarray) -> dict:
    """What each type adds to the gates of both directions, gate by type."""
    return {d: np.ascontiguousarray((x @ p[f"x{d}"] + p[f"c{d}"]).T) for d in "fb"}


def score_windows(p: dict, px: dict, kind: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logit of each window, px being the projected types. Arrays are feature by window; windows are in order of falling size, so that the ones still running stand first."""
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    n, t_max = len(first), int(size[0]) if len(size) else 0
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(t_max)]  # windows with size > t
    states = {}
    for d in "fb":
        u = p[f"u{d}"].T.copy()
        h = np.zeros((HIDDEN, n), np.float32)
        states[d] = np.zeros((t_max, HIDDEN, n), np.float32)
        for t in range(t_max):
            k = running[t]
            at = first[:k] + t if d == "f" else first[:k] + size[:k] - 1 - t
            a = px[d].take(kind[at], axis=1)
            g = u @ h[:, :k]
            rz = _sigmoid(a[: 2 * HIDDEN] + g[: 2 * HIDDEN])
            new = np.tanh(a[2 * HIDDEN :] + rz[:HIDDEN] * g[2 * HIDDEN :])
            h[:, :k] = new + rz[HIDDEN:] * (h[:, :k] - new)
            states[d][t, :, :k] = h[:, :k]
    top = np.full(n, -np.inf, np.float32)
    total, pooled = np.zeros(n, np.float32), np.zeros(n, np.float32)
    att, ends = p["att"].T.copy(), np.arange(n)
    for t in range(t_max):
        k = running[t]
        back = states["b"][size[:k] - 1 - t, :, ends[:k]].T if (size[:k] != size[0]).any() else states["b"][size[0] - 1 - t][:, :k]
        h = np.concatenate([states["f"][t][:, :k], back])
        e = p["query"] @ np.tanh(att @ h)
        m = np.maximum(top[:k], e)
        old, new = np.exp(top[:k] - m), np.exp(e - m)
        total[:k] = total[:k] * old + new
        pooled[:k] = pooled[:k] * old + new * (p["out"] @ h)
        top[:k] = m
    out = np.empty(n, np.float32)
    out[by] = pooled / np.maximum(total, np.float32(1e-9)) + p["bias"][0]
    return out


def gradients(p: dict, types, rows: np.ndarray, label: np.ndarray):
    """Loss and gradients over windows `rows` (window by place: types, -1 after the end). The character rows of types are in order of their owner."""
    word_row, char_row, owner = types
    used, rows_u = np.unique(rows, return_inverse=True)
    used, rows_u = (used[1:], rows_u.reshape(rows.shape) - 1) if used[0] < 0 else (used, rows_u.reshape(rows.shape))
    begin = np.searchsorted(owner, used)
    n = np.searchsorted(owner, used, side="right") - begin
    own_u = np.repeat(np.arange(len(used)), n)
    char_u = char_row[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(own_u))]
    x = inputs(p, word_row[used], char_u, own_u)
    b, t_max = rows_u.shape
    mask = (rows_u >= 0).astype(np.float32)
    at = np.maximum(rows_u, 0)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    cache, hs = {}, {}
    for d in "fb":
        px = x @ p[f"x{d}"] + p[f"c{d}"]
        h, kept, states = np.zeros((b, HIDDEN), np.float32), [], np.zeros((b, t_max, HIDDEN), np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            a, g = px[at[:, t]], h @ p[f"u{d}"]
            rz = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            m = mask[:, t : t + 1]
            kept.append((t, h, r, z, n, g[:, 2 * HIDDEN :], m))
            h = h + m * (1 - z) * (n - h)
            states[:, t] = h
        cache[d], hs[d] = kept, states
    h = np.concatenate([hs["f"], hs["b"]], axis=2)
    u = np.tanh(h @ p["att"])
    e = np.where(mask > 0, u @ p["query"], -1e9)
    w = np.exp(e - e.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", w, h)
    prob = _sigmoid(pooled @ p["out"] + p["bias"][0])
    loss = -np.mean(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7))
    dl = ((prob - label) / b).astype(np.float32)
    grads["out"], grads["bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
    dpool = dl[:, None] * p["out"]
    dw = np.einsum("bh,bth->bt", dpool, h)
    de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
    grads["query"] = np.einsum("bt,btk->k", de, u)
    du = de[:, :, None] * p["query"] * (1 - u * u)
    grads["att"] = np.einsum("bth,btk->hk", h, du)
    dh_all = w[:, :, None] * dpool[:, None, :] + du @ p["att"].T
    dx = np.zeros_like(x)
    for i, d in enumerate("fb"):
        dh, da_all = np.zeros((b, HIDDEN), np.float32), np.zeros((b, t_max, 3 * HIDDEN), np.float32)
        for t, h0, r, z, n, gn, m in reversed(cache[d]):
            dh = dh + dh_all[:, t, i * HIDDEN : (i + 1) * HIDDEN]
            dn = dh * m * (1 - z) * (1 - n * n)
            dz = -dh * m * (n - h0) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dr, dz, dn], axis=1)
            dg = np.concatenate([dr, dz, dn * r], axis=1)
            grads[f"u{d}"] += h0.T @ dg
            dh = dh * (1 - m * (1 - z)) + dg @ p[f"u{d}"].T
            da_all[:, t] = da
        flat, use = da_all.reshape(-1, 3 * HIDDEN), mask.ravel() > 0
        per = np.zeros((len(used), 3 * HIDDEN), np.float32)
        np.add.at(per, at.ravel()[use], flat[use])
        grads[f"x{d}"], grads[f"c{d}"] = x.T @ per, per.sum(axis=0)
        dx += per @ p[f"x{d}"].T
    np.add.at(grads["word"], word_row[used], dx[:, :DIM])
    count = np.sqrt(np.maximum(np.bincount(own_u, minlength=len(used)), 1)).astype(np.float32)
    np.add.at(grads["char"], char_u, (dx[:, DIM:] / count[:, None])[own_u])
    return float(loss), grads


def _training_types(texts: list[str]):
    """word_types of texts taken in slices, so that hashing needs little memory; a word that several slices have is a type in each."""
    docs, kinds, tables, n_types, at = [], [], [], 0, 0
    while at < len(texts):
        raw, total = [], 0
        while at + len(raw) < len(texts) and total < 1 << 19:
            raw.append(texts[at + len(raw)].encode())
            total += len(raw[-1])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        if total:
            doc, kind, word_row, char_row, own = word_types(np.frombuffer(b"".join(raw), np.uint8), offsets)
            by = np.argsort(own, kind="stable")
            docs.append(doc + at)
            kinds.append((kind + n_types).astype(np.int32))
            tables.append((word_row.astype(np.int32), char_row[by].astype(np.int32), (own[by] + n_types).astype(np.int32)))
            n_types += len(word_row)
        at += len(raw)
    return np.concatenate(docs), np.concatenate(kinds), tuple(np.concatenate(x) for x in zip(*tables, strict=True))


def _all_logits(p, types, kind, first, size) -> np.ndarray:
    px = projected(p, inputs(p, *types))
    return np.concatenate([score_windows(p, px, kind, first[i : i + 4096], size[i : i + 4096]) for i in range(0, len(first), 4096)])


def train(texts: list[str], labels: list[int], seed: int = 5) -> dict:
    """The network, from labelled texts. Without both labels among them it is untrained and scores near 0."""
    p = fresh(seed)
    label = np.array(labels, np.float32)
    if not any(texts) or not 0 < label.sum() < len(label):
        p["out"][:], p["bias"][:] = 0, -6
        return p
    doc, kind, types = _training_types(texts)
    owner, first, size = window_table(doc, len(texts))
    rows = np.where(np.arange(WINDOW) < size[:, None], kind[np.minimum(first[:, None] + np.arange(WINDOW), max(len(kind) - 1, 0))] if len(kind) else -1, -1).astype(np.int32)
    rng = np.random.default_rng(seed)
    bad, good = np.flatnonzero(label[owner] == 1), np.flatnonzero(label[owner] == 0)
    if not len(bad) or not len(good):
        p["out"][:], p["bias"][:] = 0, -6
        return p
    moment, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    done = 0
    for phase, steps in (("warm", WARM_STEPS), ("hard", HARD_STEPS // 3), ("hard", HARD_STEPS // 3), ("hard", HARD_STEPS // 3)):
        if phase == "hard":
            s = _all_logits(p, types, kind, first, size)
            worst = np.zeros(len(texts), np.int64)
            order = np.argsort(s, kind="stable")
            worst[owner[order]] = order  # the last one written is the worst window
            has = np.bincount(owner, minlength=len(texts)) > 0
            top = worst[(label == 1) & has]
            clean = order[label[owner[order]] == 0]
            hard = clean[-max(BATCH, len(clean) // 50) :]
        for _ in range(steps):
            half = BATCH // 2
            if phase == "warm":
                take = np.concatenate([rng.choice(bad, half), rng.choice(good, half)])
            else:
                take = np.concatenate([rng.choice(top, half), rng.choice(hard, half // 2), rng.choice(good, half - half // 2)])
            _, g = gradients(p, types, rows[take], label[owner[take]])
            done += 1
            for k in p:
                moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] * g[k]
                p[k] = (p[k] - np.float32(0.02) * (moment[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.99**done)) + 1e-6)).astype(np.float32)
    # the text's score is its worst window's: set the bias where that parts the training texts best
    s = _all_logits(p, types, kind, first, size)
    best = np.full(len(texts), -20.0)
    np.maximum.at(best, owner, s)
    cuts = np.sort(best)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    order = np.argsort(best)
    right = np.cumsum(np.append(0, np.where(label[order] == 0, 1, 0)))[: len(cuts)] + (label.sum() - np.cumsum(np.append(0, label[order])))[: len(cuts)]
    top = np.flatnonzero(right == right.max())
    p["bias"] -= np.float32(np.median(cuts[top]))
    return p


def score_texts(p: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each text, 0 to 1: its worst window's; 0 without words."""
    n = len(offsets) - 1
    out = np.zeros(n)
    if not len(data):
        return out
    doc, kind, *types = word_types(data, offsets)
    if not len(doc):
        return out
    px = projected(p, inputs(p, *types))
    owner, first, size = window_table(doc, n)
    for i in range(0, len(owner), 8192):
        part = slice(i, i + 8192)
        np.maximum.at(out, owner[part], 1 / (1 + np.exp(-score_windows(p, px, kind, first[part], size[part]).astype(np.float64))))
    return out


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, most_bytes: int = TRAIN_BYTES) -> dict:
    """Trains on at most `toxic` and `clean` labelled rows, in the order of a hash of doc_id, none of them held out. Each is taken whole, and those that would bring the texts over most_bytes are left out. A doc_id with both labels is toxic; of rows that repeat an id the least text counts."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    with_text = docs.select("doc_id", F.octet_length("text").alias("bytes")).where("text IS NOT NULL").join(usable, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("bytes").alias("bytes"))
    # both labels in turn, so that what the bytes leave out does not fall on one of them
    rows = [with_text.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect() for v, most in ((1, toxic), (0, clean))]
    turn = sorted((i / max(len(r), 1), one) for r in rows for i, one in enumerate(r))
    picked, total = [], 0
    for _, one in turn:
        if total + one.bytes <= most_bytes:
            total += one.bytes
            picked.append((one.doc_id, one.toxic))
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = sorted((r.doc_id, r.toxic, r.text) for r in found.collect())
    return train([t for _, _, t in texts], [y for _, y, _ in texts])


def _score(p: dict):
    def run(batches):
        import pyarrow as pa

        for part, data, offsets in vec.pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(score_texts(p, data, offsets))], names=["doc_id", "th", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, th (hash of the text), score (0 to 1). labels: (doc_id, toxic 0 or 1); null labels are left out.

    Every window of the whole text is scored. Null, empty and wordless texts score 0; repeated rows are scored each; an empty table gives an empty result; without labels of both kinds all score near 0. Other columns are not read.
    """
    p = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(_score(p), "doc_id long, th long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
