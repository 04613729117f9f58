"""Helpers that every operator of this subpackage uses: shared storage, skew-safe joins, components."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir

#: A key that holds at least 1 / HOT_SHARE of all rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 2000


def cut(df: DataFrame, *bucket: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later stages restart from files, not from the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Deletes the files of cut tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_rows: int, size: str = "size", how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with one row a key. groups.size counts a key's rows, so keys with n_rows / HOT_SHARE rows or more number HOT_SHARE at most: those are broadcast, the others shuffled. rows and groups are read twice, so they should be cut tables or cheap."""
    hot = F.col(size) >= max(1000, n_rows // HOT_SHARE)
    few = groups.where(hot)
    many = groups.where(~hot)
    by_hot = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return by_hot.unionByName(rest.join(many, keys, how))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


BIG_GROUP = 16  # neighbours of a node within one map task: more are met there already


def _neighbours(batches):
    """Of edges, after a local union-find, (key, node) in both directions. The many neighbours of a hub are linked to the least of them right here, as edges (node, to), and send one row on."""
    import numpy as np
    import pyarrow as pa

    from . import vec

    for a, b in vec.blocks_of(batches, "a", "b", rows=400_000):
        a, b = vec.forest(a, b)
        if not len(a):
            continue
        key, node = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.append(True, key[1:] != key[:-1])
        of = np.cumsum(new) - 1
        least = np.minimum(key, node[new][of])
        big = np.bincount(of)[of] > BIG_GROUP
        on = ~big | (new & (least < key))
        yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(node[on]), pa.nulls(int(on.sum()), pa.int64())], names=["key", "node", "to"])
        met = big & (node != least)
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (node, node, least)], names=["key", "node", "to"])


def _to_least(batches):
    """Of (key, node) sorted by both, an edge from each node to the least of its key and the key itself; edges go through. Holds one row between batches."""
    import numpy as np
    import pyarrow as pa

    from . import vec

    def edges():
        last_key = last = None
        for batch in batches:
            to = batch.column("to")
            entry = to.is_null().to_numpy(zero_copy_only=False)
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            out = [(node[~entry], to.drop_null().to_numpy())]
            key, node = key[entry], node[entry]
            if len(key):
                new = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
                run = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                least = np.where(run >= 0, np.minimum(key, node[np.maximum(run, 0)]), last if last is not None else 0)
                last_key, last = key[-1], least[-1]
                out.append((node[node != least], least[node != least]))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for a, b in vec.blocks_of(edges(), "a", "b", rows=400_000):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in vec.forest(a, b)], names=["a", "b"])


FEW_EDGES = 1 << 19  # that one task finishes


def _forest(batches):
    """Edges (node, least node of its component) with the components of the edges a task has, as far as blocks of FEW_EDGES reach."""
    import pyarrow as pa

    from . import vec

    for a, b in vec.blocks_of(batches, "a", "b", rows=FEW_EDGES + 1):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in vec.forest(a, b)], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b longs, in any order): one row a node that has an edge, (node, root), root the smallest node.

    Distributed union-find in rounds: each task reduces its edges by a local union-find, then every node's neighbours are linked to the least of them (star contraction), until a round changes nothing. A hub, which may have a third of all edges, is contracted within the map tasks first, so no task meets all of it. Every round is cut to the shared folder. Where FEW_EDGES edges or fewer are left, one task finishes them. An empty input gives an empty result.
    """

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    e = cut(edges.where("a != b").mapInArrow(_forest, "a long, b long"))
    was = None
    for _ in range(max_rounds):
        if (e.count() if was is None else was[0]) <= FEW_EDGES:
            new = cut(e.coalesce(1).mapInArrow(_forest, "a long, b long"))
            drop_cut(e)
            e = new
            break
        near = e.mapInArrow(_neighbours, "key long, node long, to long")
        new = cut(near.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_to_least, "a long, b long").distinct())
        now = state(new)
        drop_cut(e)
        e = new
        if not now[0] or now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
