"""Vectorised text kernels on Arrow buffers: word bounds, hashes of spans, union-find. Hashes have 64 bits and are fixed by these constants.

A span is hashed as a tree: eight bytes at a time are mixed, then neighbours in pairs until one is left. No step is linear in the bytes, so no family of texts collides by its structure, as texts do under a polynomial modulo a power of two.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
PAIR = U(0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The lowest 0 .. 8 bytes of a number.
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finaliser: one-to-one."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & MASK)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column of an Arrow batch; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def pieces(batches, text: str = "text", most: int = 1 << 20):
    """Slices of Arrow batches whose texts have about `most` bytes together, or one long text: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data as a number, zeros after the end. A view that is to be indexed or copied."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def short_grams(data: np.ndarray, starts: np.ndarray, size) -> np.ndarray:
    """The bytes of spans of at most 7 bytes as numbers, equal for equal spans only: the size stands in the highest byte."""
    size = np.broadcast_to(size, starts.shape)
    return (eights(data)[starts] & BYTES[size]) | (size.astype(U) << U(56))


def _tree(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each run of n numbers of x: neighbours are joined in pairs, an odd last one waits, until one is left."""
    out = np.empty(len(n), U)
    row = np.arange(len(n))
    while len(n):
        base = np.cumsum(n) - n
        done = n == 1
        out[row[done]] = x[base[done]]
        row, base, n = row[~done], base[~done], n[~done]
        half = (n + 1) // 2
        to = np.cumsum(half) - half
        j = 2 * (np.arange(int(half.sum())) - np.repeat(to, half))
        left = np.repeat(base, half) + j
        paired = j + 1 < np.repeat(n, half)
        new = x[left]
        new[paired] = mix(new[paired] * PAIR + x[left[paired] + 1])
        x, n = new, half
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the bytes of each span, equal for equal contents wherever they stand."""
    return span_hashes(data, starts, ends, (salt,))[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...] = (0, 8)) -> list[np.ndarray]:
    """The same under several salts; two of them give 128 bits."""
    size = ends - starts
    n = np.maximum(-(-size // 8), 1)
    at = np.repeat(starts - 8 * (np.cumsum(n) - n), n) + 8 * np.arange(int(n.sum()))
    x = eights(data)[at]
    last = np.cumsum(n) - 1
    x[last] &= BYTES[size - 8 * (n - 1)]
    return [mix(_tree(mix(x, salt), n) + size.astype(U) * PAIR, salt + 1) for salt in salts]


STEPS = 8  # of a span's end, a byte each, before the places of all kept bytes are made


def trimmed(starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the bytes at both ends that `keep` (a mask of the bytes) does not hold; spans with none of them are empty, at their start."""
    first, last = starts.copy(), ends.copy()
    todo = np.flatnonzero(first < last)
    for _ in range(STEPS):
        todo = todo[~keep[first[todo]]]
        first[todo] += 1
        todo = todo[first[todo] < last[todo]]
        if not len(todo):
            break
    where = np.append(np.flatnonzero(keep), len(keep)) if len(todo) else None
    if len(todo):
        first[todo] = np.minimum(where[np.searchsorted(where, first[todo])], last[todo])
    todo = np.flatnonzero(first < last)
    for _ in range(STEPS):
        todo = todo[~keep[last[todo] - 1]]
        if not len(todo):
            break
        last[todo] -= 1  # first is kept, so this ends there
    if len(todo):
        where = np.flatnonzero(keep) if where is None else where
        last[todo] = where[np.searchsorted(where, last[todo]) - 1] + 1
    some = first < last
    return np.where(some, first, starts), np.where(some, last, starts)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of the words [^\\x20\\x09-\\x0D]+ of each document."""
    inside = ~SPACE[data]
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first], after[last] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z lower-cased."""
    return span_hash(LOWER[data], starts, ends)


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document as (doc, hash), sorted; a document of fewer words has its whole sequence as one, one without words none."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, U)
    count = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    left = count[doc] - place  # words from here to the end of the document
    ok = (left >= k) | ((place == 0) & (count[doc] < k))
    acc, size = np.zeros(len(hashes), U), np.minimum(left, k).astype(U)
    for j in range(k):
        nxt = np.zeros(len(hashes), U)
        nxt[: max(len(hashes) - j, 0)] = hashes[j:]
        acc = mix(acc * PAIR + np.where(left > j, nxt, U(0)))
    d, h = doc[ok], mix(acc + size)[ok]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def blocks_of(batches, *names: str, rows: int):
    """Numpy columns of Arrow batches, gathered into blocks of at least `rows` rows, the last one apart."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each of n nodes' component, by vectorised hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the components of the edges (a, b)."""
    ids, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(both[: len(a)], both[len(a) :], len(ids))
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]
