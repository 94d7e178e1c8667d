"""Exact selection by rank over any number of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SMALL = 1_000_000


def nearest_rank(df: DataFrame, column: str, share: float = 0.95, small: int = SMALL) -> float | None:
    """The value at rank ceil(share n) of a column, nulls aside; None without values.

    While more than ``small`` values are left, one pass counts them in ``BUCKETS`` ranges of value and goes on in the range that holds
    the rank; the last step orders what is left. No task holds all values, as an exact percentile aggregate would.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = min(max(math.ceil(share * n), 1), n)
    while n > small and low < high:
        place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        inside = values.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        counted = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for row in sorted(counted, key=lambda r: r["low"]):
            if rank <= row["n"]:
                break
            rank -= row["n"]
        if row["n"] == n:  # all in one range: its ends are the values' own, so only ties or neighbours are left
            break
        n, low, high = row["n"], row["low"], row["high"]
    if low == high:
        return low
    left = values.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
    return left.orderBy("v").limit(rank).agg(F.max("v")).first()[0]
