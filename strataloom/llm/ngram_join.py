"""N-gram Jaccard join of documents, as a blocked sparse matrix product.

A document is a row of the incidence matrix, its distinct word n-grams the columns. Equal rows are one row. The columns are cut into blocks whose number follows from the size: a pair that reaches the threshold differs in at most (den - num) / (den + num) * (a + b) columns, so with one block more than that it agrees on a whole block. Rows that agree on a block form candidate clusters; the product (product.py) accumulates overlap counts inside each and drops pairs below the size-derived bound. What a very frequent n-gram or passage costs is bounded: it alone makes no candidate.

Two rows may agree on a block only because both have no n-gram in it. Such a block makes no key; a row that has one also gets the first n-grams of its set, by hash, as keys: as many as any row that reaches the threshold with it must share one of. So no link is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .buckets import of_lists, star_edges
from .product import linked_components
from .shared import components, cut, drop_cut, join_groups

WORDS, NUM, DEN = 3, 90, 100


def _level_table(num: int, den: int, most: int) -> np.ndarray:
    """First sizes of the size classes; a size and one num / den of it are in the same or in adjacent classes."""
    sizes = [1]
    while sizes[-1] <= most:
        sizes.append(sizes[-1] * den // num + 1)
    return np.array(sizes + [sizes[-1] * den // num + 1])


def set_keys(doc: np.ndarray, grams: np.ndarray, n_docs: int, num: int, den: int):
    """For the sets (doc, grams; sorted by both): size and two names (128 bits) of each document's set, and (document, key) for its column blocks.

    A document of size class i takes part in the block sets i and i - 1, each for sizes of two adjacent classes.
    """
    size = np.bincount(doc, minlength=n_docs)
    names = []
    for salt in (1, 6):
        name = np.zeros(n_docs, vec.U)
        np.add.at(name, doc, vec.mix(grams, salt))
        names.append(vec.mix(name + size.astype(vec.U)))
    table = _level_table(num, den, int(size.max(initial=1)))
    cls = np.searchsorted(table, np.maximum(size, 1), side="right") - 1
    deal, part = vec.mix(grams, 2) >> vec.U(32), vec.mix(grams, 3)
    docs, keys, bare = [], [], np.zeros(n_docs, bool)
    for j in (cls, cls - 1):
        most = table[np.minimum(j + 2, len(table) - 1)] - 1  # largest size in class j + 1
        k = (den - num) * 2 * most // (den + num) + 1
        k[(j < 0) | (size == 0)] = 0
        base = np.cumsum(k) - k
        use = k[doc] > 0
        at = base[doc[use]] + ((deal[use] * k[doc[use]].astype(vec.U)) >> vec.U(32)).astype(np.int64)
        total = np.zeros(int(k.sum()), vec.U)
        np.add.at(total, at, part[use])
        held = np.bincount(at, minlength=len(total)) > 0
        owner = np.repeat(np.arange(n_docs), k)
        block = np.arange(len(total)) - np.repeat(base, k)
        bare[owner[~held]] = True
        docs.append(owner[held])
        keys.append(vec.mix(vec.mix(total[held] + block[held].astype(vec.U)) + j[owner[held]].astype(vec.U), 4))
    if bare.any():
        # sets that reach the threshold share num / den of the larger one, hence one of the first n - ceil(n * num / den) + 1 grams of each
        place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        first = bare[doc] & (place <= size[doc] - -(-size[doc] * num // den))
        docs.append(doc[first])
        keys.append(vec.mix(grams[first], 5))
    return size, *names, np.concatenate(docs), np.concatenate(keys)


def _sets(part, data, offsets, k_words: int):
    starts, ends, doc = vec.words(data, offsets)
    return vec.shingles(vec.word_hashes(data, starts, ends), doc, k_words, part.num_rows)


def _signatures(k_words: int, num: int, den: int):
    def run(batches):
        import pyarrow as pa

        for part, data, offsets in vec.pieces(batches):
            size, n1, n2, owner, keys = set_keys(*_sets(part, data, offsets, k_words), part.num_rows, num, den)
            order = np.argsort(owner, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(size), *(pa.array(x.view(np.int64)) for x in (n1, n2)), lists], names=["id", "th", "n", "n1", "n2", "keys"])

    return run


def _grams(k_words: int):
    def run(batches):
        import pyarrow as pa

        for part, data, offsets in vec.pieces(batches):
            doc, grams = _sets(part, data, offsets, k_words)
            bounds = 8 * np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
            sets = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(grams.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cluster", "node", "n")), sets], names=["cluster", "node", "n", "grams"])

    return run


def jaccard_components(docs: DataFrame, k_words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row of docs (doc_id, text): doc_id, n_shingles, component_id, th (hash of the text).

    Words are the runs without white space, A-Z lower-cased; two documents link when den * |A and B| >= num * |A or B|; component_id is the least doc_id reachable by links. A document without words (null, empty, white space) is linked with nothing, itself its component; one with fewer than k_words words has its whole sequence as its one n-gram. Rows that repeat an id with other texts are judged each. A null id has its component's least id, null if none. Empty table: empty result. Columns beside doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = cut(docs.mapInArrow(_signatures(k_words, num, den), "id long, th long, n long, n1 long, n2 long, keys array<long>"))
    some = rows.where("n > 0").groupBy("n1", "n2").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("x"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("size"))
    reps = cut(some.select("n1", "n2", "x.id", "x.th", "n", "keys", "size", F.monotonically_increasing_id().alias("node")))
    clusters = components(star_edges(reps.select("node", "keys"), of_lists)).withColumnRenamed("root", "cluster")
    wanted = reps.select("node", "id", "th", "n").join(clusters, "node")
    same = (F.col("d.th") == F.col("w.th")) & F.col("d.id").eqNullSafe(F.col("w.id"))
    picked = docs.alias("d").join(wanted.alias("w").hint("merge"), same).select("cluster", "node", "n", "text").mapInArrow(_grams(k_words), "cluster long, node long, n long, grams binary")
    # rows that repeat an id and its text are fetched twice
    contents = cut(picked.dropDuplicates(["node"]))
    linked = cut(linked_components(contents, num, den).join(reps.select("node", "id"), "node"))
    of = linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    of_node = join_groups(linked, cut(of), ["root"], linked.count()).select("node", "component_id")
    known = cut(reps.join(of_node, "node", "left").select("n1", "n2", "size", F.coalesce("component_id", "id").alias("component_id")))
    drop_cut(reps, contents, linked)
    out = rows.drop("keys").withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("n1", "n2")})
    out = join_groups(out, known, ["n1", "n2"], rows.count(), how="left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "th")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT g, row_number() OVER () AS k FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
i AS (SELECT doc_id, k FROM s JOIN ids USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM i a JOIN i b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM t LEFT JOIN n USING (doc_id) JOIN r ON r.a = t.doc_id GROUP BY t.doc_id
"""
