"""Exact dedup, n-gram join, line dedup and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataloom.llm import buckets, line_dedup, ngram_join, product, shared, suffix_dedup, vec
from strataloom.llm.exact_dedup import exact_dedup
from strataloom.llm.shared import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: u.find(x) for x in u.p if x in got} and set(got) == set(u.p)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 40, 1 << 19])
def test_components_of_few_edges(spark, monkeypatch, few):
    """By rounds, by rounds that one task ends, and by one task at once."""
    monkeypatch.setattr(shared, "FEW_EDGES", few)
    rng = random.Random(5)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(1000, 1001 + i) for i in range(60)] + [(3, 3)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: u.find(x) for x in u.p}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_few_edges_take_few_jobs(spark):
    """A long path, which takes many rounds, is finished without one: written, counted, and written by one task."""
    sc = spark.sparkContext
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").repartition(4).cache()
    edges.count()
    sc.setJobGroup("few edges", "")
    found = components(edges)
    jobs = len(sc.statusTracker().getJobIdsForGroup("few edges"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 and {r.root for r in found.collect()} == {0} and found.count() == 401
    edges.unpersist()


@pytest.mark.parametrize("big", [64, 2])
def test_components_with_hubs(spark, monkeypatch, big):
    """A hub whose edges lie in several tasks, chains between hubs, repeated edges."""
    monkeypatch.setattr(shared, "BIG_GROUP", big)
    rng = random.Random(big)
    edges = [(50, 1000 + i) for i in range(400)] + [(7, 1200 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)] + [(1100, 2030), (5, 3000), (3000, 4), (4, 3001), (3001, 6)]
    edges += rng.choices(edges, k=200)
    rng.shuffle(edges)
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = [(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()]
    assert len(got) == len(u.p) and dict(got) == {x: u.find(x) for x in u.p}


def words(n, rng):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies about the threshold, and a chain of near copies."""
    rng, out = random.Random(5), []
    for _ in range(25):
        out.append(words(rng.choice((3, 8, 60, 150, 400)), rng))
    for base in list(out[:20]):
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10)}"
            out.append(w)
    chain = words(300, rng)
    for i in range(12):
        chain = list(chain)
        chain[20 * i] = f"c{i}"
        out.append(chain)
    texts = [" ".join(w) for w in out] + [" ".join(out[0]).upper(), None, "", "a b", "A B", "a"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_exact(docs, corpus):
    got = {r.doc_id: r for r in exact_dedup(docs(corpus), block_chars=64).collect()}
    groups = defaultdict(list)
    for i, t in corpus:
        groups[(t or "").translate(LOWER)].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_odd(odd, nothing):
    rows = exact_dedup(odd).collect()
    assert len(rows) == odd.count() and exact_dedup(nothing).count() == 0
    two = [r for r in rows if r.text_sha256 == hashlib.sha256(b"one two").hexdigest()]
    assert len(two) == 4 and {r.keep_id for r in two} == {6} and {r.group_size for r in two} == {4} and sum(r.kept for r in two) == 2
    assert {r.keep_id for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {2}


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_ngram_join(docs, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    u = Union()
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 90 * len(a | b):
                u.join(i, j)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs(corpus)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), u.find(i)) for i, s in sets.items()}
    assert len({u.find(i) for i in sets}) < len(sets) - 20


def test_ngram_join_odd(odd, nothing):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 5), (None, 1, 5), (7, 1, 7), (8, 1, 8)} <= got
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_blocks_lose_no_pair():
    """Sets at the threshold always agree on a column block."""
    rng = np.random.default_rng(3)
    for n in (9, 10, 19, 20, 57, 200, 700, 3000):
        for _ in range(20):
            common = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            extra = n // 19  # the most differences that both sides may have: n - e common of n + e together
            a, b = np.unique(common), np.unique(np.append(common[extra:], rng.integers(0, 1 << 62, extra, dtype=np.uint64)))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 90 * (len(a) + len(b) - inter):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            *_, owner, keys = ngram_join.set_keys(doc, np.concatenate([a, b]), 2, 90, 100)
            assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_empty_blocks_lose_no_pair(monkeypatch):
    """Where all n-grams fall into one block, the blocks that two rows agree on are the empty ones; they meet by their first n-grams."""
    real = vec.mix
    monkeypatch.setattr(ngram_join.vec, "mix", lambda x, salt=0: x & vec.U(0xFF) if salt == 2 else real(x, salt))
    rng = np.random.default_rng(9)
    for n in (40, 95, 400):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.append(a[n // 20 :], rng.integers(0, 1 << 62, n // 40, dtype=np.uint64)))
        *_, owner, keys = ngram_join.set_keys(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, 90, 100)
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_of_like_structure_stay_apart(docs, n):
    """A Thue-Morse word and its complement collide under polynomials modulo a power of two."""
    one, two = morse(n), morse(n, "b", "a")
    raw = np.frombuffer((one + two).encode(), np.uint8)
    h = vec.span_hash(raw, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    rows = [(1, f"{one} x y"), (2, f"{two} x y")]
    assert {r.component_id for r in ngram_join.jaccard_components(docs(rows)).collect()} == {1, 2}
    # as lines they are alike (their shingles are nearly the same), but not as equal lines: a third line, unlike both, shows the classes
    got = suffix_dedup.remove_repeats(docs(rows)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(x[:5] for x in brute_repeats(rows))
    other = [(1, "q" + one[: n // 2] + " is it"), (2, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(n)))]
    assert line_dedup.line_classes(docs(other)).where("NOT kept").count() == 0


def test_band_recall():
    """Of pairs of lines at a similarity of 0.8 to 0.85, 99 in 100 share a key, short ones and long ones."""
    rng = np.random.default_rng(12)
    for low, high in ((25, 60), (60, 200), (200, 900)):
        found = n = 0
        while n < 1200:
            size = int(rng.integers(low, high))
            a = rng.integers(97, 123, size).astype(np.uint8)
            b = a.copy()
            for _ in range(int(rng.integers(1, max(2, size // 60 + 2)))):
                at = int(rng.integers(size))
                b = np.concatenate([b[:at], rng.integers(97, 123, rng.integers(0, 3)).astype(np.uint8), b[at + int(rng.integers(0, 3)) :]])
            x, y = (set(line_dedup.grams_of(t.tobytes()).tolist()) for t in (a, b))
            if not 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y):
                continue
            n += 1
            keys = [line_dedup.keys_of(t, np.zeros(1, np.int64), np.full(1, len(t)))[0] for t in (a, b)]
            found += bool((keys[0] == keys[1]).any())
        assert found >= 0.99 * n, (low, high, found, n)


@pytest.mark.parametrize("held", [64, 1 << 20])
def test_packed_buckets(monkeypatch, held):
    """Equal keys are connected and others are not, and the shuffle gets a row a bucket of a block, not one a key."""
    import pyarrow as pa

    monkeypatch.setattr(buckets, "HELD", held)
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    tasks = [[(rng.choice(pool[: 3000 // (1 + t)], 500), rng.integers(0, 1 << 64, 500, dtype=np.uint64)) for _ in range(4)] for t in range(3)]
    tasks[1].append((np.full(300, pool[7]), np.arange(300, dtype=np.uint64)))  # a hot key
    sent = [batch for blocks in tasks for batch in buckets.collapsed(iter(blocks), 8)]
    n = sum(len(key) for blocks in tasks for key, _ in blocks)
    assert sum(b.num_rows for b in sent) <= 2 * 8 * sum(-(-sum(len(k) for k, _ in blocks) // held) for blocks in tasks)
    table = pa.Table.from_batches(sent).sort_by([("bucket", "ascending"), ("edge", "ascending")]).combine_chunks()
    u, want = Union(), Union()
    for batch in buckets._same_key(table.to_batches(max_chunksize=3)):
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            u.join(a, b)
    first = {}
    nodes = [(int(k), int(x)) for blocks in tasks for key, node in blocks for k, x in zip(key, node.view(np.int64), strict=True)]
    for k, x in nodes:
        want.join(first.setdefault(k, x), x)
    assert len(nodes) == n and [u.find(x) for _, x in nodes] == [want.find(x) for _, x in nodes]


def test_trimmed():
    """Against a byte by byte trim, with more white space than is stepped over."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        size = int(rng.integers(1, 150))
        keep = rng.random(size) < rng.choice([0, 0.03, 0.4, 1])
        starts = np.sort(rng.integers(0, size + 1, 6))
        ends = np.minimum(starts + rng.integers(0, 60, 6), size)
        for s, e, i, j in zip(starts.tolist(), ends.tolist(), *(x.tolist() for x in vec.trimmed(starts, ends, keep)), strict=True):
            at = np.flatnonzero(keep[s:e])
            assert (i, j) == ((s + at[0], s + at[-1] + 1) if len(at) else (s, s))


def test_line_shingles():
    """The hashes that lines get side by side are those that each gets alone, whatever stands beside it; shingles are the line's 7-byte strings."""
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = np.unique(rng.integers(0, 2900, 120))
    ends = np.maximum(np.append(starts[1:], 3000) - rng.integers(0, 4, len(starts)), starts + 1)
    keys = line_dedup.keys_of(data, starts, ends)
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        line = data[s:e].tobytes()
        assert (line_dedup.keys_of(data[s:e], np.zeros(1, np.int64), np.full(1, e - s))[0] == keys[i]).all()
        want = {line[k : k + 7] for k in range(max(1, len(line) - 6))}
        assert {x.to_bytes(8, "little")[: min(7, len(line))] for x in line_dedup.grams_of(line).tolist()} == want


def test_hashing_memory():
    """Many short lines and one very long line are hashed a slice at a time."""
    import tracemalloc

    short = np.frombuffer(b"ab cd ef \n" * 30_000, np.uint8)
    s, e, _, _ = line_dedup.line_spans(short, np.array([0, len(short)]))
    tracemalloc.start()
    line_dedup.keys_of(short, s, e)
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("dense_rows", [64, 4])
def test_product(monkeypatch, dense_rows):
    monkeypatch.setattr(product, "DENSE_ROWS", dense_rows)
    rng = np.random.default_rng(4)
    for _ in range(10):
        base = rng.integers(0, 1 << 60, 120)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(90, 120), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 12))])) for _ in range(30)]
        u = Union()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                inter = len(np.intersect1d(a, b))
                if i < j and 100 * inter >= 80 * (len(a) + len(b) - inter):
                    u.join(i, j)
        old, product.COLUMNS = product.COLUMNS, 16
        a, b = product.product_links(np.arange(30), np.array([len(s) for s in sets]), np.concatenate(sets), 80, 100)
        product.COLUMNS = old
        few = Union()
        for x, y in zip(*(z.tolist() for z in product._few_links(np.arange(30), [np.sort(s) for s in sets], 80, 100)), strict=True):
            few.join(x, y)
        assert all(u.find(i) == few.find(i) for i in range(30))
        v = Union()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            v.join(x, y)
        assert all(u.find(i) == v.find(i) for i in range(30))


def test_large_cluster_is_split(spark, docs, monkeypatch):
    """A cluster over many blocks gives what one task gives."""
    monkeypatch.setattr(product, "BLOCK_ROWS", 16)
    rng = random.Random(8)
    base = words(200, rng)
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(200)] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    u = Union()
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 90 * len(a | b):
                u.join(i, j)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs(rows)).collect()}
    assert got == {i: u.find(i) for i in sets}


def test_lines(docs, odd, nothing):
    rng = random.Random(2)
    pool = [" ".join(words(12, rng)) for _ in range(40)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(6):
            line = rng.choice(pool)
            if rng.random() < 0.3:
                line = line[:-2] + rng.choice("abc")
            lines.append(rng.choice([line, line.upper(), " " + line]))
        rows.append((i, "\n".join(lines)))
    seen, uniq = [], {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            x = x.translate(LOWER).strip().encode()
            seen.append((i, k, x))
            uniq.setdefault(x, {x[j : j + 7] for j in range(max(1, len(x) - 6))})
    u, keys = Union(), list(uniq)
    for a in keys:
        for b in keys:
            if a < b and 100 * len(uniq[a] & uniq[b]) >= 80 * len(uniq[a] | uniq[b]):
                u.join(a, b)
    first, want = set(), set()
    for i, k, x in seen:
        if u.find(x) in first:
            want.add((i, k))
        first.add(u.find(x))
    got = {(r.id, r.no) for r in line_dedup.line_classes(docs(rows)).where("NOT kept").collect()}
    assert got == want and want
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert all(texts[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t in rows)
    assert line_dedup.line_classes(nothing).count() == 0
    # rows that repeat an id and its text are one document, so 10 has two dropped lines and 5, 6 and the null id share one
    dropped = sorted((r.id, r.no) for r in line_dedup.line_classes(odd).where("NOT kept AND id IS NOT NULL").collect())
    assert (10, 2) in dropped and (10, 3) in dropped and (5, 0) in dropped and (6, 0) in dropped


def test_large_keys_lose_no_line(docs, monkeypatch):
    """A key's lines over many blocks."""
    monkeypatch.setattr(product, "BLOCK_ROWS", 16)
    monkeypatch.setattr(product, "BLOCK_GRAMS", 4000)
    base = "the quick brown fox jumps over the lazy dog again and again until the night comes and the stars shine over the hills "
    rows = [(i, base * 2 + f"end {i:03d}") for i in range(80)]
    got = [r for r in line_dedup.line_classes(docs(rows)).where("NOT kept").collect()]
    assert len(got) == 79


def test_repeated_starts():
    rng = np.random.default_rng(1)
    for _ in range(15):
        base = bytes(rng.integers(97, 100, 300).astype("u1"))
        texts = []
        for _ in range(rng.integers(2, 9)):
            a = rng.integers(0, 150)
            x = bytearray(base[a : a + rng.integers(20, 150)])
            if rng.random() < 0.5 and len(x) > 5:
                x[rng.integers(0, len(x))] = 120
            texts.append(bytes(x))
        least = int(rng.integers(3, 40))
        hit = suffix_dedup.repeated_starts(np.concatenate([np.frombuffer(t + b"\xff", "u1") for t in texts]), least)
        count, at = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1)), 0
        for t in texts:
            assert all(hit[at + i] == (count[t[i : i + least]] > 1) for i in range(len(t) - least + 1))
            at += len(t) + 1


def brute_repeats(rows, least=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + least] for _, t in texts for k in range(len(t) - least + 1))
    out = []
    for i, t in texts:
        m = np.zeros(len(t) + 1, int)
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                m[k] += 1
                m[k + least] -= 1
        m = np.cumsum(m)[:-1] > 0
        edge = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        kept = np.frombuffer(t, "u1")[~m].tobytes()
        out.append((i, len(t), int(m.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("cap", [4096, 1])
def test_repeats(docs, monkeypatch, cap):
    """With cap 1 every hash of several classes goes the way of oversized ones."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CLASSES", cap)
    rng = random.Random(6)
    passage = " ".join(words(90, rng))
    rows = [(i, " ".join(words(rng.randrange(10, 200), rng)) + (passage[rng.randrange(100) :] if i % 3 else "") + " ".join(words(20, rng))) for i in range(24)]
    rows += [(30, rows[2][1]), (31, "ab" * 400), (32, "é" * 199), (33, None), (34, ""), (35, passage[:199]), (36, "".join(chr(97 + rng.randrange(26)) for _ in range(250)) * 2)]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs(rows)).collect())
    assert [(*g[:5], bytes(g[5])) for g in got] == sorted(brute_repeats(rows))


def test_repeats_odd(odd, nothing, spark):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()}
    assert {(1, 0, 0), (7, 150000, 150000), (8, 30000, 30000), (6, 7, 0)} <= got


def test_words():
    raw = ["A b\tc", "", "  ", "x", "\nq  r\n"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in raw])])
    s, e, d = vec.words(data, off)
    assert [(int(k), data[i:j].tobytes().decode()) for i, j, k in zip(s, e, d, strict=True)] == [(0, "A"), (0, "b"), (0, "c"), (3, "x"), (4, "q"), (4, "r")]
