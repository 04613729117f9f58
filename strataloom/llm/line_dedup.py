"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find.

A line is compared without A-Z case and without the white space at its ends. Its character shingles are dealt into BINS bins by hash (one-permutation MinHash; empty bins are filled by dealing the shingles again); BANDS bands of ROWS bins make its keys, the bins of a band standing far apart so that one shingle of a short line does not fill a band. Two lines that share a key are compared: at a similarity of 0.8 that has a chance of 1 - (1 - 0.8 ** 5) ** 14 = 0.996, at 0.85 of 0.9996. The blocked product compares the lines of a cluster exactly, whatever its size. Of each component the first line, by document and place, stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .buckets import collapsed, star_edges
from .product import linked_components
from .shared import components, cut, drop_cut, join_groups

CHARS, NUM, DEN = 7, 80, 100  # bytes of a shingle (7 at most, so that shingles are compared as they are), threshold
BANDS, ROWS = 14, 5
BINS = BANDS * ROWS
FULL = (1 << 8 * CHARS) - 1
DEALS = 6  # of the shingles into bins, while bins are empty
SLICE_BYTES = 1 << 18  # what is split into lines at a time
SEEN_LINES = 1 << 18  # that a task remembers
KEY_BYTES, KEY_LINES = 1 << 15, 1024  # what is hashed at a time


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(start, end, document, number) of the lines of each text, white space at the ends cut off; blank lines are left out but counted."""
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.concatenate([offsets[full], breaks + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    starts = np.unique(starts)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    number = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0)) if len(doc) else doc
    starts, ends = vec.trimmed(starts, ends, ~vec.SPACE[data])
    some = starts < ends
    some[some] = ~vec.SPACE[data[starts[some]]]
    return starts[some], ends[some], doc[some], number[some]


def gram_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, hash): how many shingles each line has (a shorter line is one shingle), and the hashes of them all. The lines stand in order and do not overlap."""
    at, size = starts - starts[0], ends - starts
    eights = vec.eights(data[starts[0] : ends[-1]])
    x = eights[:-1] & vec.BYTES[CHARS]
    short = size < CHARS
    if short.any():
        x[at[short]] = (eights[at[short]] & vec.BYTES[size[short]]) | (size[short].astype(vec.U) << vec.U(56))
    count = np.maximum(size - CHARS + 1, 1)
    runs = np.empty((len(at), 2), np.int64)
    runs[:, 0], runs[:, 1] = count, np.append(at[1:], len(x)) - at - count
    h = x[np.repeat(np.arange(2 * len(at)) % 2 == 0, runs.ravel())]
    for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        h *= vec.U(odd)
        h ^= h >> vec.U(32)
    return count, h


def band_keys(count: np.ndarray, h: np.ndarray) -> np.ndarray:
    """BANDS keys of each line, of gram_hashes. A bin is a range of the hash, so the least hash in it is the one of the shingles dealt there."""
    n, none = len(count), ~vec.U(0)
    low = np.full(n * BINS, none)
    base = np.repeat(np.arange(n, dtype=vec.U) * vec.U(BINS), count)
    for deal in range(DEALS):  # lines with empty bins: their shingles are dealt again, by another hash, and fill only those
        g = h * vec.U((0xD6E8FEB86659FD93 * (2 * deal + 1)) & vec.MASK) if deal else h
        at = (base + (((g >> vec.U(32)) * vec.U(BINS)) >> vec.U(32))).view(np.int64)
        if deal:
            use = empty[at]
            at, g = at[use], g[use]
        np.minimum.at(low, at, g)
        empty = low == none
        left = empty.reshape(n, BINS).any(axis=1)
        if not left.any():
            break
        if not left.all():
            used = np.repeat(left, count)
            base, h, count = base[used], h[used], np.where(left, count, 0)
    low, empty = low.reshape(n, BINS), empty.reshape(n, BINS)
    if left.any():  # at last the next filled bin, around the end
        part, hole = low[left], empty[left]
        place = np.where(hole, 2 * BINS, np.arange(BINS))
        twice = np.minimum.accumulate(np.concatenate([place, place + BINS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        low[left] = np.take_along_axis(part, twice % BINS, axis=1) + (twice - np.arange(BINS)).astype(vec.U) * vec.U(0x9E3779B97F4A7C15)
    acc = np.zeros((n, BANDS), vec.U)
    for r in range(ROWS):
        acc += low[:, r * BANDS : (r + 1) * BANDS]
        acc *= vec.PAIR
        acc ^= acc >> vec.U(32)
    return vec.mix(acc + np.arange(BANDS, dtype=vec.U), 42)


def keys_of(data, starts, ends) -> np.ndarray:
    """band_keys of lines that stand in order, KEY_LINES lines or KEY_BYTES bytes (or one long line) at a time."""
    out, i = [np.zeros((0, BANDS), vec.U)], 0
    while i < len(starts):
        j = max(i + 1, min(i + KEY_LINES, int(np.searchsorted(ends, starts[i] + KEY_BYTES, side="right"))))
        out.append(band_keys(*gram_hashes(data, starts[i:j], ends[i:j])))
        i = j
    return np.concatenate(out)


def _lines(batches):
    """(id, th, no, lh, lh2) of each line; lh and lh2 together are a line's identity."""
    import pyarrow as pa

    for part, data, offsets in vec.pieces(batches, most=SLICE_BYTES):
        s, e, doc, no = line_spans(data, offsets)
        if len(s):
            low, at = vec.LOWER[data], pa.array(doc)
            both = (pa.array(h.view(np.int64)) for h in vec.span_hashes(low, s, e))
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("th").take(at), pa.array(no.astype(np.int32)), *both], names=["id", "th", "no", "lh", "lh2"])


def _entries(batches, n_buckets: int):
    """Collapsed (key, node) of the lines, the node being lh (a chance match of 64 bits only adds a candidate). A line that the task has just seen is left out: it would give the same rows."""

    def blocks():
        seen: set[int] = set()
        for _, data, offsets in vec.pieces(batches, most=SLICE_BYTES):
            s, e, _, _ = line_spans(data, offsets)
            if len(s):
                low = vec.LOWER[data]
                lh, first = np.unique(vec.span_hash(low, s, e), return_index=True)
                new = np.fromiter((h not in seen for h in lh.tolist()), bool, len(lh))
                if len(seen) > SEEN_LINES:
                    seen.clear()
                seen.update(lh.tolist())
                order = np.argsort(first[new])
                lh, first = lh[new][order], first[new][order]
                yield keys_of(low, s[first], e[first]).ravel(), np.repeat(lh, BANDS)

    return collapsed(blocks(), n_buckets)


def _contents(batches):
    """The lines listed in `at` (no, lh, lh2, cluster), lower-cased, each with the number of its distinct shingles."""
    import pyarrow as pa

    for part, data, offsets in vec.pieces(batches, most=SLICE_BYTES):
        s, e, doc, no = line_spans(data, offsets)
        raw = vec.LOWER[data].tobytes()
        at = part.column("at")
        o = at.offsets.to_numpy()
        wanted = at.values.slice(o[0], o[-1] - o[0]).flatten()
        lh, lh2, cluster, place = (wanted[at.type.value_type.get_field_index(c)] for c in ("lh", "lh2", "cluster", "no"))
        if len(place):
            ids = np.repeat(np.arange(part.num_rows), np.diff(o)) << 32 | place.to_numpy()
            which = np.searchsorted(doc << 32 | no, ids)
            lines = [raw[i:j] for i, j in zip(s[which].tolist(), e[which].tolist(), strict=True)]
            n = pa.array([len(grams_of(x)) for x in lines], pa.int64())
            yield pa.RecordBatch.from_arrays([cluster, lh, lh2, n, pa.array(lines, pa.binary())], names=["cluster", "lh", "lh2", "n", "grams"])


def grams_of(line: bytes) -> np.ndarray:
    """Distinct shingles of a line, as they are: the size of a shorter one stands in the highest byte."""
    n = len(line) - CHARS + 1
    if n < 1:
        return np.array([int.from_bytes(line, "little") | len(line) << 56], np.int64)
    x = np.ndarray((n,), "<i8", line + b"\0", strides=(1,)) & FULL
    x.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _same_doc(a: str, b: str) -> Column:
    return (F.col(f"{a}.th") == F.col(f"{b}.th")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))


def line_classes(docs: DataFrame) -> DataFrame:
    """One row a line of docs (doc_id, text): id, th (hash of the text), no, cid (the identity of one line of its component), kept.

    Null and empty texts and blank lines have no row. Rows that repeat an id and its text are one document, whose lines stand here once a row; lines of equal normalised text are equal whatever their case. Null ids stand before others. An empty table gives an empty result. Other columns are not read.
    """
    rows = _base(docs)
    lines = cut(rows.mapInArrow(_lines, "id long, th long, no int, lh long, lh2 long"))
    clusters = components(star_edges(rows.select("text"), _entries)).select(F.col("node").alias("lh"), F.col("root").alias("cluster"))
    rep = lines.groupBy("lh", "lh2").agg(F.min(F.struct("id", "th", "no")).alias("r"), F.count(F.lit(1)).alias("n_lines"))
    rep = cut(rep.join(clusters, "lh", "left").where("n_lines > 1 OR cluster IS NOT NULL"))
    at = rep.where("cluster IS NOT NULL").select("r.id", "r.th", F.struct("r.no", "lh", "lh2", "cluster").alias("x")).groupBy("id", "th").agg(F.collect_list("x").alias("at"))
    picked = rows.alias("d").join(at.alias("a").hint("merge"), _same_doc("d", "a")).select("text", "at").mapInArrow(_contents, "cluster long, lh long, lh2 long, n long, grams binary")
    # rows that repeat an id and its text give a line twice
    contents = cut(picked.dropDuplicates(["lh", "lh2"]).withColumn("node", F.monotonically_increasing_id()))
    linked = linked_components(contents, NUM, DEN, grams_of)
    name = contents.select("node", "lh", "lh2")
    roots = linked.join(name, "node").join(name.select(F.col("node").alias("root"), F.struct("lh", "lh2").alias("cid")), "root").select("lh", "lh2", "cid")
    # the first line is told among distinct lines, so that lines meet one table only
    members = cut(rep.join(roots, ["lh", "lh2"], "left").select("lh", "lh2", "r", "n_lines", F.coalesce("cid", F.struct("lh", "lh2")).alias("cid")))
    firsts = cut(members.groupBy("cid").agg(F.min("r").alias("first"), F.sum("n_lines").alias("total"), F.count(F.lit(1)).alias("size")).where("total > 1"))
    classes = join_groups(members, firsts, ["cid"], members.count()).select("lh", "lh2", "cid", "first", F.col("n_lines").alias("size"))
    classes = cut(classes)
    drop_cut(rep, contents, members, firsts)
    out = join_groups(lines, classes, ["lh", "lh2"], lines.count(), how="left")
    kept = F.col("first").isNull() | F.struct("id", "th", "no").eqNullSafe(F.col("first"))
    return out.select("id", "th", "no", F.coalesce("cid", F.struct("lh", "lh2")).alias("cid"), kept.alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the dropped lines taken out: doc_id, text; a text all of whose lines go is empty, a null text stays null."""
    gone = line_classes(docs).where("NOT kept").groupBy("id", "th").agg(F.collect_set("no").alias("gone"))
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"))
    kept = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i.cast("int"))))
    return rows.alias("d").join(gone.alias("g"), _same_doc("d", "g"), "left").select(F.col("d.id").alias("doc_id"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its lines that are not blank, those dropped, and their numbers (from 0, blank lines counted)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = line_classes(docs).groupBy("id", "th").agg(F.size(F.collect_set("no")).cast("long").alias("n_lines"), F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("no")))).alias("dropped"))
    rows = _base(docs).drop("text")
    return rows.alias("d").join(each.alias("g"), _same_doc("d", "g"), "left").select(F.col("d.id").alias("doc_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
