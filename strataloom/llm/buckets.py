"""Candidate buckets: rows (key, node) in, edges out that connect the nodes of each key.

A map task first collapses its own rows of a key to one, so a key with a third of all rows sends a few rows a task through the shuffle. Keys are dealt into buckets, ranges of the key; what a task has of a bucket is sent as one row of packed numbers, so the shuffle sorts and copies a small part of the rows that there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vec

HELD = 1 << 20  # rows that a map task collapses together
SHARES = 16  # buckets to a shuffle partition
SCHEMA = "bucket int, edge boolean, a binary, b binary"


def _rows_out(a, b, place, n_buckets: int, edge: bool):
    """Rows (bucket, edge, a, b) of numbers a, b that stand in order of place, a 64-bit number: a bucket is a range of it."""
    import pyarrow as pa

    bucket = (place >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    offsets = pa.py_buffer((8 * np.append(start, len(bucket))).astype(np.int32).tobytes())
    packed = (pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())]) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(np.full(len(start), edge)), *packed], names=["bucket", "edge", "a", "b"])


def _ordered(key: np.ndarray, bits: int, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of a run) of keys by their highest or lowest 64 - bits bits, for up to 1 << bits of them: the sort of one number is several times faster than that of an index."""
    low = np.uint64((1 << bits) - 1)
    x = (key & ~low if high else key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64)
    x.sort()
    rest = x >> np.uint64(bits)
    return (x & low).astype(np.int64), np.append(True, rest[1:] != rest[:-1])


def _runs(new: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs, and edges (node, least node of its run)."""
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(node)))
    several = np.repeat(size > 1, size)
    if not several.any():
        return start, node[:0], node[:0]
    many, of = node[several], size[size > 1]
    least = np.repeat(np.minimum.reduceat(many, np.cumsum(of) - of), of)
    return start, many[many != least], least[many != least]


def collapsed(blocks, n_buckets: int):
    """blocks of numpy arrays (key, node), unsigned: of each HELD rows one row a key, and edges from its other nodes to that one, as packed rows."""

    def flush(key, node):
        order, new = _ordered(key, HELD.bit_length() - 1, True)  # keys that agree in 44 bits may break each other's runs: then a key has two rows
        key, node = key[order], node[order]
        new[1:] |= key[1:] != key[:-1]
        start, a, b = _runs(new, node)
        yield _rows_out(key[start], node[start], key[start], n_buckets, False)
        if len(a):
            a, b = vec.forest(a, b)
            yield _rows_out(a, b, a, n_buckets, True)

    held, n = [], 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        while n >= HELD:
            key, node = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from flush(key[:HELD], node[:HELD])
            held, n = [(key[HELD:], node[HELD:])], n - HELD
    if n:
        yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))


def of_lists(batches, n_buckets: int):
    """Rows (node, keys) as collapsed rows."""

    def blocks():
        for batch in batches:
            lists = batch.column("keys")
            node = batch.column("node").to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            yield lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), np.repeat(node, np.diff(offsets)).view(np.uint64)

    return collapsed(blocks(), n_buckets)


def _same_key(batches):
    """Of packed rows sorted by bucket, an edge from each node to the least of its key; edges go through. Holds one bucket. Keys of a bucket that agree in the lowest 64 bits less those that number its rows count as one, which only adds a candidate."""
    import pyarrow as pa

    def flush():
        key, node = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, new = _ordered(key, len(key).bit_length(), False)
        return _runs(new, node[order])[1:]

    held, now = [], None
    for batch in batches:
        out = []
        bucket, edge = batch.column("bucket").to_numpy(), batch.column("edge").to_numpy(zero_copy_only=False)
        cols = [vec.string_buffers(batch.column(c)) for c in ("a", "b")]
        start = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (edge[1:] != edge[:-1]))) if len(bucket) else []
        for i, j in zip(start, np.append(start[1:], len(bucket)), strict=True):
            pair = [np.frombuffer(data[o[i] : o[j]].tobytes(), np.uint64) for data, o in cols]
            if edge[i]:
                out.append(pair)
                continue
            if held and bucket[i] != now:
                out.append(flush())
            now = bucket[i]
            held.append(pair)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True)], names=["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in flush()], names=["a", "b"])


def star_edges(rows: DataFrame, entries) -> DataFrame:
    """entries(batches, n_buckets) makes collapsed() rows of the batches of rows: edges (a, b) that connect the nodes of each key."""
    n = SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(lambda batches: entries(batches, n), SCHEMA)
    return packed.repartition("bucket").sortWithinPartitions("bucket", "edge").mapInArrow(_same_key, "a long, b long")
