"""Blocked sparse matrix product of a row-by-gram incidence with itself, inside clusters of candidate rows.

A small cluster is one task. The rows of a larger one are dealt into blocks (by size class, then by hash), and the work is done in two passes. The first multiplies each block with itself and with one row of each size class, which links nearly all rows of a group of near copies at a cost linear in the group. The second multiplies the pairs of blocks whose rows the first has not brought into one component: rows of the cluster's largest component are not met with each other again.

A task holds two blocks at most, accumulates overlap counts over blocks of columns, drops pairs whose bound falls below the overlap that their sizes ask for, and returns a spanning forest of the pairs that reach it. No row per pair is made.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .shared import components, cut, join_groups

BLOCK_ROWS = 256
BLOCK_GRAMS = 1 << 19
COLUMNS = 2048
FEW_ROWS = 4  # up to that, pairs are counted one by one
DENSE_ROWS = 64  # more rows than that: columns of few rows are multiplied pair by pair, the others densely


def level(n, num: int, den: int):
    """Size class: sizes within num / den of each other are in the same or in adjacent classes."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) * 1.0001)).cast("int")


def _plan(rows: DataFrame) -> DataFrame:
    """Of rows (cluster, lv, part, n, node): per cluster its rows (size) and grams, and by size class and part the number of blocks and the least node."""
    kinds = rows.groupBy("cluster", "lv", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("node").alias("pivot"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_GRAMS)).cast("int")
    of = F.map_from_entries(F.collect_list(F.struct(F.col("lv") * 2 + F.col("part"), F.struct(blocks.alias("nb"), "pivot"))))
    return kinds.groupBy("cluster").agg(F.sum("c").alias("size"), F.sum("w").alias("w"), of.alias("of"))


def _blocks(lv, part, at=None):
    """The blocks (class, part, number) of a size class; with `at`, the row's own one."""
    nb = F.coalesce(F.try_element_at("of", lv * 2 + part)["nb"], F.lit(0))
    if at is not None:
        return F.struct((lv * 2 + part).alias("k"), F.pmod(F.xxhash64(at, F.lit(11)), nb).cast("int").alias("b"))
    return F.when(nb > 0, F.transform(F.sequence(F.lit(0), F.greatest(nb, F.lit(1)) - 1), lambda b: F.struct((lv * 2 + part).alias("k"), b.cast("int").alias("b")))).otherwise(F.array().cast("array<struct<k:int,b:int>>"))


def _meeting(mine, others):
    """Task of two blocks, whichever of them asks."""
    return F.transform(others, lambda o: F.xxhash64("cluster", F.least(mine, o), F.greatest(mine, o)))


def first_tasks(members: DataFrame, num: int, den: int) -> DataFrame:
    """members (cluster, node, n) with lv, `large` and the tasks of the first pass."""
    rows = members.withColumns({"lv": level(F.col("n"), num, den), "part": F.lit(0)})
    plan = cut(_plan(rows))
    n = plan.agg(F.sum("size")).first()[0] or 0
    lv, zero = F.col("lv"), F.lit(0)
    mine = _blocks(lv, zero, F.col("node"))
    pivot = F.try_element_at("of", lv * 2)["pivot"] == F.col("node")
    own = _meeting(mine, F.array(mine))
    near = F.concat(*(F.transform(_blocks(lv + d, zero), lambda o: F.xxhash64("cluster", o, o)) for d in (-1, 0, 1)))
    large = (F.col("size") > BLOCK_ROWS) | (F.col("w") > BLOCK_GRAMS)
    tasks = F.when(~large, F.array(F.xxhash64("cluster"))).when(pivot, near).otherwise(own)
    return join_groups(rows, plan, ["cluster"], n).select("cluster", "node", "n", "lv", large.alias("large"), tasks.alias("tasks"))


def second_tasks(members: DataFrame, linked: DataFrame) -> DataFrame:
    """members (cluster, node, n, lv) of large clusters with the tasks of the second pass; linked: (node, root) of the first."""
    rows = members.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = rows.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("size"))
    main = cut(main.select("cluster", "size", F.col("m.root").alias("main")))
    n = main.agg(F.sum("size")).first()[0] or 0
    rows = cut(join_groups(rows, main, ["cluster"], n).select("cluster", "node", "n", "lv", F.when(F.col("root") == F.col("main"), 1).otherwise(0).alias("part")))
    lv, rest, largest = F.col("lv"), F.lit(0), F.lit(1)
    mine = _blocks(lv, F.col("part"), F.col("node"))
    with_rest = F.concat(*(_blocks(lv + d, rest) for d in (-1, 0, 1)))
    with_main = F.when(F.col("part") == 0, F.concat(*(_blocks(lv + d, largest) for d in (-1, 0, 1)))).otherwise(F.array().cast("array<struct<k:int,b:int>>"))
    return join_groups(rows, cut(_plan(rows)), ["cluster"], n).select("node", _meeting(mine, F.concat(with_rest, with_main)).alias("tasks")).where(F.size("tasks") > 0)


def _rare_pairs(owner: np.ndarray, col: np.ndarray, most: int = 1 << 22):
    """The pairs of rows (i, j) that share a column, once for each such column, in parts of about `most` pairs. Columns stand in order; those with equally many rows are taken together."""
    count = np.bincount(col)
    held, n = [], 0
    for d in np.unique(count[count > 1]):
        rows = np.sort(owner[count[col] == d].reshape(-1, d), axis=1)
        a, b = np.triu_indices(d, 1)
        step = max(1, most // len(a))
        for k in range(0, len(rows), step):
            held.append((rows[k : k + step][:, a].ravel(), rows[k : k + step][:, b].ravel()))
            n += len(held[-1][0])
            if n >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def product_links(nodes: np.ndarray, sizes: np.ndarray, grams: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the row pairs with den * overlap >= num * union. grams: the rows' distinct grams, one row after another."""
    r = len(nodes)
    owner = np.repeat(np.arange(r), sizes)
    _, col, cnt = np.unique(grams, return_inverse=True, return_counts=True)
    shared = cnt[col] > 1  # a gram of one row adds to no overlap
    renamed = np.cumsum(cnt > 1) - 1
    owner, col = owner[shared], renamed[col[shared]]
    width = int((cnt > 1).sum())
    need = (num * (sizes[:, None] + sizes[None, :]) / (num + den)).astype(np.float32)  # den * o >= num * (a + b - o)
    left = np.bincount(owner, minlength=r).astype(np.float32)
    alive = np.minimum(left[:, None], left[None, :]) >= need - 1e-3
    np.fill_diagonal(alive, False)
    keep = alive.any(axis=1)
    if not keep.any():
        return nodes[:0], nodes[:0]
    place = np.cumsum(keep) - 1
    used = keep[owner]
    owner, col = place[owner[used]], col[used]
    nodes, sizes, left, need = nodes[keep], sizes[keep], left[keep], need[np.ix_(keep, keep)]
    r = len(nodes)
    acc = np.zeros((r, r), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    if r > DENSE_ROWS:  # rare columns first, pair by pair of the few rows that have them
        count = np.bincount(col, minlength=width)
        rare = count[col] <= max(2, r // 16)
        for i, j in _rare_pairs(owner[rare], col[rare]):
            acc += np.bincount(i * r + j, minlength=r * r).reshape(r, r)
        acc += acc.T
        owner, col = owner[~rare], col[~rare]
        left = np.bincount(owner, minlength=r).astype(np.float32)
        alive = acc + np.minimum(left[:, None], left[None, :]) >= need - 1e-3
        np.fill_diagonal(alive, False)
        keep = alive.any(axis=1)
        if not keep.any():
            return nodes[:0], nodes[:0]
        used = keep[owner]  # the other rows' pairs cannot reach their bounds any more
        owner, col = (np.cumsum(keep) - 1)[owner[used]], np.unique(col[used], return_inverse=True)[1]
        nodes, sizes, left, need, acc = nodes[keep], sizes[keep], left[keep], need[np.ix_(keep, keep)], acc[np.ix_(keep, keep)]
        r, width = len(nodes), int(col.max(initial=-1)) + 1
    step = max(COLUMNS, min(width, (1 << 21) // r))
    for c in range(0, width, step):
        lo, hi = np.searchsorted(col, [c, c + step])
        if lo == hi:
            continue
        dense = np.zeros((r, min(step, width - c)), np.float32)
        dense[owner[lo:hi], col[lo:hi] - c] = 1
        acc += dense @ dense.T
        left = left - dense.sum(axis=1)
        if c + step < width and not (np.triu(acc + np.minimum(left[:, None], left[None, :]) >= need - 1e-3, 1)).any():
            return nodes[:0], nodes[:0]  # no pair can reach its bound any more
    inter = np.rint(acc).astype(np.int64)
    linked = np.triu(den * inter >= num * (sizes[:, None] + sizes[None, :] - inter), 1)
    i, j = np.nonzero(linked)
    return vec.forest(nodes[i], nodes[j]) if len(i) else (nodes[:0], nodes[:0])


def _few_links(nodes: np.ndarray, rows: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a handful of rows, row by row."""
    a, b = [], []
    for j in range(1, len(rows)):
        for i in range(j):
            small, large = sorted((len(rows[i]), len(rows[j])))
            if den * small >= num * large:
                both = np.concatenate([rows[i], rows[j]])
                both.sort(kind="stable")  # two sorted runs
                inter = int((both[1:] == both[:-1]).sum())
                if den * inter >= num * (small + large - inter):
                    a.append(nodes[j])
                    b.append(nodes[i])
    return np.array(a, np.int64), np.array(b, np.int64)


def packed(content: bytes) -> np.ndarray:
    """64-bit grams that stand side by side."""
    return np.frombuffer(content, np.int64)


def _scan(num: int, den: int, grams_of):
    def scan(batches):
        import pyarrow as pa

        def flush():
            if len(held) > 1:
                nodes, at = np.unique(np.array([x[0] for x in held], np.int64), return_index=True)
                if len(nodes) > 1:
                    rows = [grams_of(held[i][1]) for i in at]
                    a, b = _few_links(nodes, rows, num, den) if len(rows) <= FEW_ROWS else product_links(nodes, np.array([len(x) for x in rows]), np.concatenate(rows), num, den)
                    if len(a):
                        out.append((a, b))
            held.clear()

        held, key, out = [], None, []
        for batch in batches:
            tasks, nodes = batch.column("task").to_numpy(), batch.column("node").to_numpy()
            data, offsets = vec.string_buffers(batch.column("grams"))
            for i in range(batch.num_rows):
                if tasks[i] != key:
                    flush()
                    key = tasks[i]
                held.append((nodes[i], data[offsets[i] : offsets[i + 1]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

    return scan


def linked_pairs(rows: DataFrame, num: int, den: int, grams_of=packed) -> DataFrame:
    """rows: (tasks, node, grams binary, from which grams_of makes the distinct grams of the row's set). Returns edges (a, b) that connect what the pairs reaching num / den connect."""
    dealt = rows.select(F.explode("tasks").alias("task"), "node", "grams")
    # a given number of partitions, since the few bytes of a task say little of its work
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "task").sortWithinPartitions("task").mapInArrow(_scan(num, den, grams_of), "a long, b long")


def linked_components(contents: DataFrame, num: int, den: int, grams_of=packed) -> DataFrame:
    """contents: a cut table (cluster, node, n, grams), n the number of a row's distinct grams, node unique. (node, root) of the rows that links connect, two rows of a cluster being linked where den * |A and B| >= num * |A or B|. Rows of different clusters are never linked directly."""
    members = contents.select("cluster", "node", "n")
    first = cut(first_tasks(members, num, den))
    dealt = lambda tasks: contents.select("node", "grams").join(tasks.select("node", "tasks"), "node")
    linked = components(linked_pairs(dealt(first), num, den, grams_of))
    large = first.where("large").select("cluster", "node", "n", "lv")
    if large.isEmpty():
        return linked
    second = linked_pairs(dealt(second_tasks(large, linked)), num, den, grams_of)
    return components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
