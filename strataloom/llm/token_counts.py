"""Token counts with a digest cache.

A text's digest is the SHA-256 of the tokenizer's version digest and the normalised content (null as empty, nothing else: the tokenizer tells all other texts apart). Counts stored under a digest are joined; only distinct digests without one are encoded, and then appended to the cache.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, join_groups, shared_dir

LIMIT = 512
#: Texts of these characters only are cut into pieces here; others go to the library whole, whose Unicode tables may differ.
PLAIN = r"[\t\n\r -~¡-ɏ]*"
#: How byte-level BPE cuts a text into pieces (letters, digits, other signs, white space), for PLAIN texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-ZªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼½¾]+| ?[^\s0-9²³¹¼½¾a-zA-ZªµºÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"
PIECE_CACHE = 400_000
MISSES_SENT = 100_000  # digests that go to every task to pick the texts to encode; more are joined by a shuffle


def version_digest(path: str) -> str:
    """Of the vocabulary file, the library's version and how it is called."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{tokenizers.__version__}|no added specials, specials in texts parsed, whole texts".encode()).hexdigest()


class _Pieces(dict):
    """Tokens of a piece, by the library's model; forgets all when full."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))
        if len(self) >= PIECE_CACHE:
            self.clear()
        self[piece] = n
        return n


def counter(path: str):
    """A function from texts to counts as the tokenizers library gives them for this file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kind = tokenizer.pre_tokenizer.__class__.__name__ if tokenizer.pre_tokenizer else ""
    plain_kind = kind == "ByteLevel" and tokenizer.normalizer is None and not tokenizer.pre_tokenizer.add_prefix_space and tokenizer.model.__class__.__name__ == "BPE"
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    plain, cut, pieces = re.compile(PLAIN).fullmatch, re.compile(PIECES).findall, _Pieces(tokenizer)

    def count(texts: list[str]) -> list[int]:
        out = []
        for t in texts:
            if plain_kind and not any(s in t for s in specials) and plain(t):
                out.append(sum(map(pieces.__getitem__, cut(t))))
            else:
                out.append(len(tokenizer.encode(t, add_special_tokens=False).ids))
        return out

    return count


def _encode(path: str, version: str):
    def run(batches):
        import pyarrow as pa

        count = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * b.num_rows), pa.array(count(b.column("text").to_pylist()), pa.int64())], names=["digest", "version", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """One row per input row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens.

    cache_path: a folder of Parquet files (digest, version, n_tokens) that all executors share; it is made if missing and appended to. tokenizer_path must name the same file on every node. Null text counts as empty (0 tokens); repeated rows are counted each, encoded once; an empty table gives an empty result. Other columns are not read.

    Only digests are joined with the cache; texts are moved for misses alone, one a digest.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(version + "|"), text), 256).alias("digest")
    rows = cut(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest))
    distinct = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size")))
    schema = "digest string, version string, n_tokens long"
    texts = docs.select(digest, text.alias("text"))
    once = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    if _exists(spark, cache_path):
        stored = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version)
        misses = cut(distinct.join(stored.select("digest"), "digest", "left_anti").select("digest"))
        few = misses.count() <= MISSES_SENT
        texts = once(texts.join(F.broadcast(misses), "digest", "left_semi")) if few else once(texts).join(misses, "digest", "left_semi")
    else:
        texts = once(texts)
    texts.mapInArrow(_encode(tokenizer_path, version), schema).write.mode("append").parquet(cache_path)
    # two writers may both have stored a digest
    stored = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = cut(distinct.join(stored, "digest"))
    return join_groups(rows, counts, ["digest"], distinct.agg(F.sum("size")).first()[0] or 0).select("doc_id", "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so its figures are those of a first run."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache/{uuid.uuid4().hex}"
    counted = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
