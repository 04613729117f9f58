"""Removal of long repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

Two equal strings of `least` bytes have equal lowest hashes among the GRAM-byte strings inside them. So the places are dealt by that hash: runs of neighbouring starts with one lowest hash form a segment, and only segments whose hash occurs again are looked at. Segments with equal bytes (128 bits of hash) are one class; its starts repeat when it has two members. A map task already collapses the classes it sees, so a passage in a third of all documents sends a few rows a task. Where a hash has several classes, one text of each goes to a shard. There a breadth-first backward extension on the shard's BWT sets the common-prefix lengths in increasing order and stops at `least`: what is unset then are the neighbours that share `least` bytes or more.

A hash with over SHARD_CLASSES classes is counted exactly by whole windows, dealt over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .shared import cut, join_groups

LEAST = 200
GRAM = 72
LONGEST_RUN = 1024  # starts in a segment
PART_BYTES = 1 << 22  # of a longer text, the starts of so many bytes are looked at together
PLACE_BITS = 24  # more than PART_BYTES and a piece of texts need
HELD = 1 << 18  # segments that a map task collapses together
SHARD_BYTES = 2 << 20
SHARD_CLASSES = 4096
END = 255  # a byte that UTF-8 never has


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise running minima."""
    n = len(x)
    m = -(-n // w) * w
    pad = np.full(m, ~vec.U(0))
    pad[:n] = x
    rows = pad.reshape(-1, w)
    down = np.minimum.accumulate(rows, axis=1).ravel()
    up = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[: n - w + 1], down[w - 1 : n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes (8 or more) from each place, by doubling. It only deals the places out, so it is a light one: a collision makes a shard larger, no result wrong."""
    h, size = vec.eights(data)[: len(data) - 7] * vec.PAIR, 8
    while True:
        h ^= h >> vec.U(29)
        if size == gram:
            return h
        step = min(size, gram - size)
        more = h[step:] * vec.U(0xBF58476D1CE4E5B9)
        h, size = h[: len(h) - step] * vec.PAIR, size + step
        h += more


def segments(data: np.ndarray, offsets: np.ndarray, least: int, gram: int):
    """Of texts: (document, first start, starts, lowest hash, two hashes of all bytes, whether the lowest hash stands at several places) of each segment.

    The lowest hash is taken by its upper bits, ties by the first place; so equal strings have it at the same distance from their starts.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, vec.U),) * 3 + (np.zeros(0, bool),)
    if len(data) < least:
        return none
    hashes = gram_hashes(data, gram)
    at = np.arange(len(hashes))
    assert len(at) <= 1 << PLACE_BITS
    mask = vec.U((1 << PLACE_BITS) - 1)
    place = window_min((hashes & ~mask) | at.astype(vec.U), least - gram + 1) & mask
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - least + 1, 0))
    if not len(doc):
        return none
    first = np.concatenate([[0], np.cumsum(np.maximum(lengths - least + 1, 0))])[:-1]
    local = np.arange(len(doc)) - first[doc]
    place = place[offsets[doc] + local].astype(np.int64)
    low = hashes[place]
    new = np.ones(len(doc), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(doc)))
    moved = np.append(False, place[1:] != place[:-1]) & ~new
    several = np.add.reduceat(moved, run, dtype=np.int64) > 0
    if (size > LONGEST_RUN).any():  # long runs are cut at fixed distances from their first start
        parts = -(-size // LONGEST_RUN)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(run, parts) + k * LONGEST_RUN
        size = np.minimum(np.repeat(run + size, parts) - start, LONGEST_RUN)
        run, several = start, np.repeat(several, parts)
    begin = offsets[doc[run]] + local[run]
    whole = vec.span_hashes(data, begin, begin + size - 1 + least)
    return doc[run], local[run], size, low[run], *whole, several


SEGMENTS = "h long, c long, c2 long, id long, th long, lo int, n int, own boolean, twice boolean, known boolean"


def _parts(batches, least: int):
    """Slices of texts, or parts of one long text whose starts follow each other: (slice, first start, bytes, offsets)."""
    for part, data, offsets in vec.pieces(batches):
        if len(data) <= PART_BYTES:
            yield part, 0, data, offsets
            continue
        for lo in range(0, len(data) - least + 1, PART_BYTES - least):
            one = data[lo : lo + PART_BYTES - 1]
            yield part, lo, one, np.array([0, len(one)])


def _anchor(least: int, gram: int):
    """Segments, HELD at a time: of a class with several members, all but the first are known to repeat and need meet no other; the first says so (twice)."""

    def run(batches):
        import pyarrow as pa

        def flush():
            rows = pa.concat_tables(held).combine_chunks()
            c, c2 = rows["c"].to_numpy(), rows["c2"].to_numpy()
            order = np.lexsort((c2, c))
            new = np.append(True, (c[order][1:] != c[order][:-1]) | (c2[order][1:] != c2[order][:-1]))
            of = np.cumsum(new) - 1
            known, twice = np.ones(len(c), bool), np.zeros(len(c), bool)
            known[order[new]] = False
            twice[order] = np.bincount(of)[of] > 1
            h = rows["h"].to_numpy().copy()
            h[known] = vec.mix(np.arange(int(known.sum()), dtype=vec.U)).view(np.int64)  # dealt anywhere
            yield from rows.set_column(0, "h", pa.array(h)).append_column("twice", pa.array(twice)).append_column("known", pa.array(known)).to_batches()

        held, n = [], 0
        for part, from_, data, offsets in _parts(batches, least):
            doc, lo, size, low, c, c2, own = segments(data, offsets, least, gram)
            if not len(doc):
                continue
            at = pa.array(doc)
            ints = (pa.array((lo + from_).astype(np.int32)), pa.array(size.astype(np.int32)))
            held.append(pa.table([*(pa.array(x.view(np.int64)) for x in (low, c, c2)), part.column("id").take(at), part.column("th").take(at), *ints, pa.array(own)], names=["h", "c", "c2", "id", "th", "lo", "n", "own"]))
            n += len(doc)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return run


def _classes(batches):
    """Of segments sorted by (h, c, c2): with kind 0 each member of a class of two or more, with kind 1 one member of each class that may repeat in part: its hash has several classes, or stands at several places in the segment (own). Holds two rows between batches."""
    import pyarrow as pa
    import pyarrow.compute

    names = ["h", "c", "c2", "id", "th", "lo", "n", "own"]
    out = lambda rows, kind: rows.select(names).append_column("kind", pa.array(np.full(len(rows), kind, np.int32))).combine_chunks().to_batches()
    held = None  # (rows, weight, full done, class done)
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        yield from out(rows.filter(rows["known"]), 0)
        rows = rows.filter(pa.compute.invert(rows["known"]))
        weight, full_done, class_done = 1 + rows["twice"].to_numpy().astype(np.int64), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        if held is not None:
            rows = pa.concat_tables([held[0], rows])
            weight, full_done, class_done = (np.concatenate(x) for x in zip(held[1:], (weight, full_done, class_done), strict=True))
        if not len(rows):
            continue
        h, c, c2 = (rows[x].to_numpy() for x in ("h", "c", "c2"))
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, (c[1:] != c[:-1]) | (c2[1:] != c2[:-1]))
        of_c, of_h = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
        full = (np.bincount(of_c, weights=weight)[of_c] >= 2) & ~full_done
        several = (np.bincount(of_h[new_c])[of_h] >= 2) | rows["own"].to_numpy()
        rep = new_c & several & ~class_done
        for kind, mask in ((0, full), (1, rep)):
            if mask.any():
                yield from out(rows.filter(pa.array(mask)), kind)
        first_c, first_h = np.flatnonzero(new_c)[-1], np.flatnonzero(new_h)[-1]
        pick = [first_h] if first_h == first_c else [first_h, first_c]
        total = np.bincount(of_c, weights=weight).astype(np.int64)
        held = (rows.take(pa.array(pick)), np.minimum(total[of_c[pick]], 2), (full | full_done)[pick], (rep | class_done)[pick])


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Which positions of text start a string of `least` bytes that starts at another position too. Texts inside it end with END; strings across END do not matter and may be marked.

    Suffixes are sorted to a depth of `least` or more by prefix doubling; their BWT then gives all common prefixes below `least` by breadth-first backward extension of intervals.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, vec.U)
    for j in range(8):
        key = (key << vec.U(8)) | padded[j : j + n].astype(vec.U)
    _, rank = np.unique(key, return_inverse=True)
    depth = 8
    while depth < least and rank.max() + 1 < n:
        after = np.zeros(n, np.int64)
        after[: n - depth] = rank[depth:] + 1 if depth < n else 0
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)
        depth *= 2
    suffix = np.argsort(rank, kind="stable")
    bwt = text[suffix - 1]
    order = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)  # LF mapping
    forward[order] = np.arange(n)
    letters, firsts = np.unique(bwt[order], return_index=True)
    ends = np.append(firsts[1:], n)
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lb, rb = np.zeros(1, np.int64), np.full(1, n, np.int64)  # the interval of the empty string
    for _ in range(least):  # common prefixes of length 0, 1, ..., least - 1
        found_l, found_r = [], []
        size = rb - lb
        small = size <= 16
        if small.any():
            l, s = lb[small], size[small]
            own = np.repeat(np.arange(len(l)), s)
            at = np.arange(len(own)) - np.repeat(np.cumsum(s) - s, s) + l[own]
            to, ch = forward[at], bwt[at]
            if len(l) != len(own):
                by = np.argsort(own * n + to)
                own, to, ch = own[by], to[by], ch[by]
            start = np.append(True, (own[1:] != own[:-1]) | (ch[1:] != ch[:-1]))
            stop = np.append(start[1:], True)
            ok = ch[start] != END
            found_l.append(to[start][ok])
            found_r.append(to[stop][ok] + 1)
        if not small.all():
            l, r = lb[~small], rb[~small]
            for a, i, j in zip(letters, firsts, ends, strict=True):
                if a != END:
                    x, y = np.searchsorted(order[i:j], l) + i, np.searchsorted(order[i:j], r) + i
                    found_l.append(x[x < y])
                    found_r.append(y[x < y])
        lb, rb = np.concatenate(found_l), np.concatenate(found_r)
        fresh = unset[rb]
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        unset[rb] = False
    out = np.zeros(n, bool)
    out[suffix] = unset[:-1] | unset[1:]
    return out


def _shards(least: int):
    def run(batches):
        import pyarrow as pa

        def ranges(rows):
            text = np.concatenate([np.frombuffer(x[4] + b"\xff", np.uint8) for x in rows])
            hit = repeated_starts(text, least)
            out = []
            at = 0
            for _, i, th, lo, ctx in rows:
                starts = len(ctx) - least + 1
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[at : at + starts].astype(np.int8), [0]])))
                out += [(i, th, lo + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                at += len(ctx) + 1
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64() if k < 2 else pa.int32()) for k in range(4)], names=["id", "th", "lo", "n"])

        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(x).to_pylist() for x in ("h", "id", "th", "lo", "ctx")), strict=True):
                if size >= SHARD_BYTES and row[0] != last:
                    yield ranges(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield ranges(held)

    return run


def _contexts(least: int):
    """Texts of the segments listed in `at` (h, lo, n, big): one row a segment, or one a start of a big hash (with the window's two hashes)."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("ctx", pa.binary()), ("big", pa.bool_())])
        for part, data, offsets in vec.pieces(batches):
            rows = []
            raw = data.tobytes()
            for i, (one, th, at) in enumerate(zip(*(part.column(x).to_pylist() for x in ("id", "th", "at")), strict=True)):
                for s in at:
                    begin = int(offsets[i]) + s["lo"]
                    if s["big"]:
                        rows += [(0, one, th, s["lo"] + j, hashlib.blake2b(raw[begin + j : begin + j + least], digest_size=16).digest(), True) for j in range(s["n"])]
                    else:
                        rows.append((s["h"], one, th, s["lo"], raw[begin : begin + s["n"] - 1 + least], False))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema=schema)

    return run


def repeated_ranges(rows: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """rows (id, th, text): start ranges (id, th, lo, n) whose strings of `least` bytes start elsewhere too, th being the text's hash."""
    found = rows.mapInArrow(_anchor(least, gram), SEGMENTS)
    kinds = "h long, c long, c2 long, id long, th long, lo int, n int, own boolean, kind int"
    found = cut(found.repartition("h").sortWithinPartitions("h", "c", "c2").mapInArrow(_classes, kinds))
    full = found.where("kind = 0").select("id", "th", "lo", "n")
    reps = found.where("kind = 1").select("h", "id", "th", "lo", "n")
    classes = cut(reps.groupBy("h").agg(F.count(F.lit(1)).alias("size")))
    sized = join_groups(reps, classes, ["h"], classes.agg(F.sum("size")).first()[0] or 0)
    at = sized.groupBy("id", "th").agg(F.collect_list(F.struct("h", "lo", "n", (F.col("size") > SHARD_CLASSES).alias("big"))).alias("at"))
    same = (F.col("r.th") == F.col("a.th")) & F.col("r.id").eqNullSafe(F.col("a.id"))
    texts = rows.alias("r").join(at.alias("a"), same).select("r.id", "r.th", "text", "at")
    contexts = cut(texts.mapInArrow(_contexts(least), "h long, id long, th long, lo int, ctx binary, big boolean"))
    small = contexts.where("NOT big").select("h", "id", "th", "lo", "ctx").repartition("h").sortWithinPartitions("h").mapInArrow(_shards(least), "id long, th long, lo int, n int")
    windows = contexts.where("big").select("ctx", "id", "th", "lo")
    twice = windows.groupBy("ctx").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ctx")
    big = windows.join(twice, "ctx", "left_semi").select("id", "th", "lo", F.lit(1).alias("n"))
    return full.unionByName(small).unionByName(big)


def _strip(least: int):
    def run(batches):
        import pyarrow as pa

        for part, data, offsets in vec.pieces(batches):
            raw = data.tobytes()
            sizes, removed, spans, sha, kept = [], [], [], [], []
            for i, at in enumerate(part.column("at").to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                parts, end, cut_bytes, runs = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["lo"] + s["n"] - 1 + least) for s in at or ()):
                    if lo > end or not runs:
                        parts.append(text[end:lo])
                        runs += 1
                        cut_bytes += hi - lo
                        end = hi
                    elif hi > end:
                        cut_bytes += hi - end
                        end = hi
                parts.append(text[end:])
                left = b"".join(parts)
                sizes.append(len(text))
                removed.append(cut_bytes)
                spans.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per input row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Every byte that a string of `least` bytes covers which also starts elsewhere (in any row, overlaps count) is removed; matches never cross rows and are judged on the input. Null text counts as empty; texts shorter than `least` lose nothing; a row given twice repeats itself; null ids are allowed; an empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    at = repeated_ranges(rows, least).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("at"))
    same = (F.col("r.th") == F.col("a.th")) & F.col("r.id").eqNullSafe(F.col("a.id"))
    whole = rows.alias("r").join(at.alias("a"), same, "left").select("r.id", "text", "at")
    return whole.mapInArrow(_strip(least), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 199)) AS i, h FROM d WHERE length(h) >= 400),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM p),
again AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM k JOIN again USING (k)),
f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS f FROM c),
g AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
spans AS (SELECT doc_id, g, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY doc_id, g),
kept AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo) AS n, count(*) AS m FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN lo IS NULL THEN h ELSE substr(h, 1, 2 * lo[1]) || array_to_string(list_transform(range(1, len(lo) + 1), lambda j: substr(h, 2 * hi[j] + 1, 2 * (coalesce(lo[j + 1], length(h) // 2) - hi[j]))), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
