"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's rows, in hashed order, are cut into blocks of ``block_bytes``. With target weight w, held as an exact fraction, block j
of a source has release floor(j / w) and deadline ceil((j + 1) / w); a slot goes to the released block of earliest deadline.
Such a schedule meets all deadlines, so after any number of slots each source has had its share to within less than
one block. A row belongs to the block of its first byte and is not split, so in bytes the deviation is below one block
and the longest row. Blocks grow with the corpus, so that there are at most ``SLOTS`` of them and one a source.

The schedule depends on the sources' sizes alone, one number each. It is made on the driver and filed as a table of the shared folder;
rows find their blocks by prefix sums in two levels: within hashed buckets of a source, and over the buckets' totals. The number
of buckets grows with the corpus, so that a source that holds a third of all rows is spread over as many tasks as its size asks for.

No row is dropped or repeated: when a source ends, its slots stay empty; ``on_target`` marks the slots up to the first source's
end, for which the deviation holds. Sources without a weight come after all others, mixed among themselves by default weights.

Defined results: a null source is a source of its own; a null text has no bytes and takes the place after the
rows before it; very long texts fill as many blocks as they cover, whose slots have no other rows; ties of deadlines go by the
source's bytes, and rows of equal hash by key; repeated rows are separate rows; ids may be of any type that can be hashed;
an empty table gives an empty result. Columns named as the added ones are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import cut, scratch

BLOCK_BYTES = 64 << 10
#: Blocks are at least BLOCK_BYTES and at least this share of all bytes.
SLOTS = 1 << 20
#: Bytes of one bucket of a source that has all of the corpus; such buckets are sorted in one task each.
BUCKET_BYTES = 128 << 20
#: A schedule of at most so many rows (about 50 bytes each) is broadcast; a longer one meets the rows by a shuffle.
BROADCAST_SLOTS = 1 << 21
SMOOTHING = 0.7
ADDED = ("n_bytes", "block", "slot", "release", "deadline", "offset", "on_target")
_LAST = (1 << 63) - 1


def shares(weights: Mapping[str, float]) -> dict[str, Fraction]:
    """The positive weights as exact fractions that sum to one."""
    exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
    total = sum(exact.values())
    return {k: w / total for k, w in exact.items()}


def schedule(weights: Mapping[str, Fraction], counts: Mapping[str, int], begin: int = 0) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, j, slot, release, deadline) for ``counts`` blocks of each source: earliest deadline first among the released ones."""
    window = {k: (w.numerator, w.denominator) for k, w in weights.items()}
    waiting = [(0, k, 0) for k in sorted(weights) if counts[k]]
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]  # the slots of sources that have ended
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            p, q = window[k]
            heapq.heappush(ready, (-(-(j + 1) * q // p), k, j, release))
        due, k, j, release = heapq.heappop(ready)
        yield k, j, begin + slot, begin + release, begin + due
        if j + 1 < counts[k]:
            p, q = window[k]
            heapq.heappush(waiting, ((j + 1) * q // p, k, j + 1))
        slot += 1


def plan(sizes: Mapping[str, int], weights: Mapping[str, float], block_bytes: int) -> tuple[list[tuple[str, int, int, int, int]], int]:
    """The whole schedule, and the last slot before a source of positive weight has ended."""
    counts = {k: max(1, -(-v // block_bytes)) for k, v in sizes.items()}
    rows: list[tuple[str, int, int, int, int]] = []
    first = shares(weights)
    rows += schedule(first, counts)
    ends = [t for k, j, t, _, _ in rows if j + 1 == counts[k]]
    rest = {k: float(max(1, v)) ** SMOOTHING for k, v in sizes.items() if k not in first}
    rows += schedule(shares(rest), counts, rows[-1][2] + 1 if rows else 0)
    return rows, min(ends, default=-1)


def _filed(spark: SparkSession, rows: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """The schedule as a table of the shared folder."""
    folder = scratch(spark, "schedule")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/schedule.csv")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        for i in range(0, len(rows), 50_000):
            out.write("".join(",".join([x[0], *(str(min(v, _LAST)) for v in x[1:])]) + "\n" for x in rows[i : i + 50_000]).encode())
    finally:
        out.close()
    names = ", ".join(f"{_own(x)} {'string' if x == 'ps' else 'long'}" for x in ("ps", "pj", "slot", "release", "deadline"))
    return spark.read.schema(names).csv(folder)


def _own(name: str) -> str:
    """A column name that does not clash with the input's."""
    return f"__scanloom_{name}"


def _source(column: str) -> Column:
    """The source's bytes in hexadecimal, so that any text survives the schedule's file; a null is a dash."""
    return F.coalesce(F.concat(F.lit("="), F.hex(F.col(column).cast("string"))), F.lit("-"))


def source_name(value: str | None) -> str:
    return "-" if value is None else "=" + value.encode().hex().upper()


def mix_sources(df: DataFrame, weights: Mapping[str | None, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", block_bytes: int | None = None, seed: int = 0) -> DataFrame:
    """``df`` with the columns of ``ADDED``; training order is (slot, offset). Default weights: bytes to the power 0.7."""
    spark = df.sparkSession
    df = df.drop(*ADDED)
    s, b, h, n, before, at = (_own(x) for x in ("source", "bucket", "hash", "bytes", "before", "block"))
    rows = df.withColumns({s: _source(source), n: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), h: F.xxhash64(F.lit(seed), F.col(key), F.col(text))})
    sizes = {x[s]: x["total"] for x in rows.groupBy(s).agg(F.sum(n).alias("total")).collect()}  # a number for each source
    whole = sum(sizes.values())
    block_bytes = block_bytes or max(BLOCK_BYTES, -(-whole // SLOTS))
    named = None if weights is None else {source_name(k): w for k, w in weights.items()}
    target = {k: float(v) ** SMOOTHING if named is None else named.get(k, 0.0) for k, v in sizes.items()}
    slots, horizon = plan(sizes, target, block_bytes)
    table = _filed(spark, slots)
    if len(slots) <= BROADCAST_SLOTS:
        table = F.broadcast(table)

    rows = rows.withColumn(b, F.pmod(h, F.lit(max(64, -(-whole // BUCKET_BYTES)))))
    totals = cut(rows.groupBy(s, b).agg(F.sum(n).alias("total")))
    of, bucket, start, last = (_own(x) for x in ("of", "of_bucket", "start", "last"))
    running = Window.partitionBy(of).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    final = F.greatest(F.ceil(F.sum("total").over(Window.partitionBy(of)) / F.lit(block_bytes)), F.lit(1)).cast("long") - 1
    offsets = totals.select(F.col(s).alias(of), F.col(b).alias(bucket), "total").withColumns({start: F.coalesce(F.sum("total").over(running), F.lit(0)), last: final}).drop("total")
    inside = Window.partitionBy(s, b).orderBy(h, key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(before, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    placed = placed.join(offsets, (F.col(s) == F.col(of)) & (F.col(b) == F.col(bucket))).withColumn(before, F.col(before) + F.col(start))
    placed = placed.withColumn(at, F.least(F.expr(f"{before} div {block_bytes}L"), F.col(last)))
    timed = placed.join(table, (F.col(s) == F.col(_own("ps"))) & (F.col(at) == F.col(_own("pj"))))
    slot, release, deadline = (F.col(_own(x)) for x in ("slot", "release", "deadline"))
    added = (F.col(n), F.col(at), slot, release, deadline, F.col(before) - F.col(at) * block_bytes, slot <= F.lit(horizon))
    return timed.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(name) for name, c in zip(ADDED, added)))
