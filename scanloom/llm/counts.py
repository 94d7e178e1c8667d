"""Token counts with a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens): the SHA-256 of the normalised content, the
SHA-256 of the tokenizer's file, and the count. A call joins the corpus' digests to it, encodes each
distinct missing text once, appends the new counts in one atomic write and joins counts to rows.

Normalisation only maps null to the empty text, since any other change could change the count. Equal
texts share one entry. The text meets the encoder through a join on (id, digest) of one representative per
digest: the representatives come from a min() that is combined before its shuffle, so a hot text costs one row
per task. Null ids and repeated rows keep one result row per input row; texts of any length are encoded whole, one at a time where they
are longer than ``ENCODE_BYTES``; of equal texts the one of least id is encoded; ids may be of any type, and columns of other names
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import cut
from scanloom.llm.tokens import slices

ENCODE_BYTES = 1 << 20
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
_encoders: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(path: str, texts: list[str]) -> list[int]:
    """Counts without begin, end or added special tokens; the encoder is loaded once per process."""
    if path.endswith(".model"):
        if path not in _encoders:
            import sentencepiece

            _encoders[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(x) for x in _encoders[path].encode(texts, num_threads=1)]
    if path not in _encoders:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        _encoders[path] = encoder
    return [len(x) for x in _encoders[path].encode_batch(texts, add_special_tokens=False)]


def encode_counts(df: DataFrame, tokenizer_name: str) -> DataFrame:
    """(content, n_tokens) of a table (content, text). The model file is found on the executor by its name."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, seen = locate(tokenizer_name), set()
        for batch in slices(batches, "text", ENCODE_BYTES):
            # copies that share id and text come to the same task: one is encoded
            fresh = np.array([not (c in seen or seen.add(c)) for c in batch.column("content").to_pylist()], dtype=bool)
            batch = batch.filter(pa.array(fresh))
            counts = _count(path, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return df.select("content", "text").mapInArrow(encode, "content binary, n_tokens long")


def locate(tokenizer_name: str) -> str:
    """A public tokenizer's file by name, or the path itself when one is given."""
    if "/" in tokenizer_name:
        return tokenizer_name
    import public_tokenizers

    return str(public_tokenizers.path(tokenizer_name))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent or empty folder is an empty cache."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(df: DataFrame, tokenizer_name: str, cache_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row; counts come from the cache, which this call completes first."""
    spark = df.sparkSession
    version = tokenizer_digest(locate(tokenizer_name))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("content"))
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    one_each = rows.groupBy("content").agg(F.min("key").alias("key"))
    misses = one_each.join(known, "content", "left_anti")
    wanted = misses.withColumnsRenamed({"key": "k", "content": "c"}).hint("shuffle_hash")
    texts = rows.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("content") == F.col("c")), "left_semi")
    fresh = encode_counts(texts, tokenizer_name).dropDuplicates(["content"])
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # cut, so that the last join has plain sides and a hot text's rows can be split over tasks
    counts = cut(open_cache(spark, cache_path).where(F.col("tokenizer") == version).dropDuplicates(["content"]))
    sized = rows.select("key", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts.select("content", "n_tokens"), "content", "left").select(F.col("key").alias(key), "n_bytes", "n_tokens")
