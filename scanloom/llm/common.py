"""Small helpers of the training-data operators; the shared folder is the library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.storage import WIDE, cut, discard, scratch, shared_dir, stored

__all__ = ["KEY", "WIDE", "ascii_bucket", "cut", "discard", "keyed", "row_key", "scratch", "shared_dir", "stored"]

#: Name of an internal row key; long and prefixed so that it does not clash with input columns.
KEY = "__scanloom_key"


def ascii_bucket(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def row_key(*columns: str) -> Column:
    """Never-null 64-bit key of a row's id and content."""
    return F.xxhash64(*columns)


#: Up to so many keys (8 bytes each) are broadcast.
BROADCAST_KEYS = 1_000_000


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with KEY: equal for rows of equal ``columns``, different for all others.

    Keys are hashes of 62 bits, not below 0. Those that a second hash shows to be shared by different rows are found first, by an aggregate that is combined before its
    shuffle, and their rows take their key from both hashes. Equal hashes of 188 bits in all are taken as equal rows.
    """
    second = f"{KEY}_second"
    hashed = df.withColumns({KEY: F.shiftrightunsigned(row_key(*columns), 2), second: F.xxhash64(F.lit(1), *columns)})
    shared = cut(hashed.groupBy(F.col(KEY).alias(f"{KEY}_of")).agg(F.min(second).alias("low"), F.max(second).alias("high")).where("low <> high").select(f"{KEY}_of"))
    n = shared.count()
    if not n:
        return hashed.drop(second)
    shared = F.broadcast(shared) if n <= BROADCAST_KEYS else shared
    met = hashed.join(shared, F.col(KEY) == F.col(f"{KEY}_of"), "left")
    return met.withColumn(KEY, F.when(F.col(f"{KEY}_of").isNull(), F.col(KEY)).otherwise(F.shiftrightunsigned(F.xxhash64(KEY, second, F.lit(2)), 2))).drop(second, f"{KEY}_of")
