"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketch: in round i < t every shingle falls into a hashed bin with a hashed value; in round t + j every shingle falls into bin
j. A bin keeps its least (round, value), and a document is done when its t bins are full, which round 2t
guarantees; each coordinate agrees between two documents with probability equal to their Jaccard similarity
and the number that agree is concentrated as for independent samples. Long documents need one or two rounds.

Steps: (1) rows with equal shingle sets (count and 128-bit digest) form a class with its least id, by an
aggregate that is combined before the shuffle, so thousands of copies cost one row per task. (2) Class representatives are put
into one bucket per band. (3) In each bucket every member is compared with one leader, not with
every other; links are confirmed on full sets and components are found. (4) Buckets whose members are not in one component
are compared across components in blocks of bounded size. No pair in a bucket is left both
untried and unconnected, so no link is lost to the grouping.

With 50 bands of 7 rows a pair at similarity 0.8 shares no band with probability below 1e-5, and pairs at 0.05 share
one with probability 4e-8, so that chance buckets stay rare in large corpora.

Defined results: null text or text without words has an empty set, links with nothing and is its own component;
fewer words than a shingle give the whole sequence as one shingle; rows with the same id are one node; a
null id links as any other, and gets the least non-null id of its component or null; ids may be whole numbers or text, and are
then ordered as such; very long texts are read whole, in memory of some sixty bytes a word; a similarity of just ``percent`` links, and equal
least values of a bin are one value; columns of other names are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import KEY, cut, keyed, stored
from scanloom.llm.tokens import grams, mix, slices, split_words
from scanloom.operators.components import sized_components

BANDS = 50
ROWS = 7
SLICE_BYTES = 2 << 20
#: Blocks of large groups hold sets of about so many shingles (8 bytes each).
BLOCK_SHINGLES = 100_000
#: Ids are broadcast to the text scan up to so many rows of 8 bytes; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000
_NULL_BASE = 1 << 62
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted within it, and the offsets of each text's set."""
    words = split_words(column, lower=True)
    hashed, whole = grams(words, size)
    counts = np.maximum(words.counts - size + 1, 0)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    counts[short] = 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    values = np.empty(offsets[-1], dtype=np.uint64)
    long_words = np.ones(len(values), dtype=bool)
    long_words[offsets[short]] = False
    values[long_words] = hashed[whole]
    for n in range(1, size):
        own = short[words.counts[short] == n]
        if len(own):
            values[offsets[own]] = grams(words, n)[0][words.first[own]]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    starts = offsets[:-1][counts > 0]
    fresh[starts] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], kept[offsets]


def sketches(values: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """A (texts, bins) array of sketches; a text with an empty set keeps all bins empty."""
    texts = len(offsets) - 1
    out = np.full((texts, bins), _FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    active = np.flatnonzero(np.diff(offsets))
    for i in range(2 * bins):
        if not len(values):
            break
        x = mix(values ^ mix(np.array([i + 1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        at = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + at, np.uint64(i << 32) | (x & np.uint64(0xFFFFFFFF)))
        open_ = (out[active] == _FULL).any(axis=1)
        if open_.all():
            continue
        active = active[open_]
        keep = np.zeros(texts, dtype=bool)
        keep[active] = True
        keep = keep[owner]
        values, owner = values[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketch), bands))
    for r in range(rows):
        key = mix(key ^ parts[:, :, r]) + np.uint64(r)
    return key


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """An order-free 64-bit digest of each set."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(seed)), dtype=np.uint64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _signed(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            values, offsets = shingle_sets(batch.column("text"), size)
            keys = band_keys(sketches(values, offsets, bands * band_rows), bands, band_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(_long(keys.reshape(-1))))
            columns = [batch.column("id"), pa.array(np.diff(offsets)), pa.array(_long(_sums(values, offsets, 0x1F83D9ABFB41BD6B))), pa.array(_long(_sums(values, offsets, 0x5BE0CD19137E2179))), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d1", "d2", "bands"])

    return rows.mapInArrow(sign, "id long, n long, d1 long, d2 long, bands array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, set): the full sets as packed 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            values, offsets = shingle_sets(batch.column("text"), size)
            sets = pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            columns = [batch.column("id"), pa.array(_long(_sums(values, offsets, 0x1F83D9ABFB41BD6B))), sets]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "d1", "set"])

    return rows.mapInArrow(pack, "id long, d1 long, set binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sets without repeats."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                good[i] = _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _shared(batch: pa.Table, percent: int) -> pa.Table:
    """Links found in one block: each minority row against all rows that share a bucket and are not connected yet."""
    ids = batch["id"].to_numpy()
    _, rows = np.unique(ids, return_index=True)  # a row may come as both roles
    ids, labels, sizes = ids[rows], batch["component"].to_numpy()[rows], batch["n"].to_numpy()[rows]
    minor = dict(zip(batch["id"].to_pylist(), batch["minor"].to_pylist()))
    sets = [np.frombuffer(batch["set"][int(r)].as_buffer(), np.uint64) for r in rows]
    buckets: dict[int, list[int]] = {}
    own = [batch["buckets"][int(r)].as_py() for r in rows]
    for i, keys in enumerate(own):
        for key in keys:
            buckets.setdefault(key, []).append(i)
    root = {c: c for c in labels.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found: list[tuple[int, int]] = []
    for i in range(len(ids)):
        if not minor[int(ids[i])]:
            continue
        for j in {j for key in own[i] for j in buckets[key]}:
            x, y = find(int(labels[i])), find(int(labels[j]))
            if x == y or 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
                continue
            if _similar(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                found.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within buckets (bucket, id, n, leader, component).

    Rows that hang together over buckets form a group. Its most frequent component is its majority; any pair of
    different components has a row outside that. So the group is cut into blocks of bounded size, and its other rows, in blocks too, meet
    each of them. Small groups share a block. No list of pairs is made.
    """
    groups = sized_components(open_.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    rows = open_.groupBy("id", "n", "component").agg(F.collect_set("bucket").alias("buckets")).join(groups.withColumnsRenamed({"id": "g", "component": "grp"}), F.col("id") == F.col("g"))
    rows = cut(rows.select("id", "n", "component", "buckets", "grp"))
    counts = rows.groupBy("grp", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    shape = counts.groupBy(F.col("grp").alias("of")).agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("s").alias("total"), (F.sum("s") - F.max_by("s", F.struct("c", "component"))).alias("rest"))
    blocks = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / F.lit(BLOCK_SHINGLES)).cast("int")
    shape = shape.withColumns({"blocks": blocks("total"), "others": blocks("rest")})
    known = rows.join(shape, F.col("grp") == F.col("of")).withColumn("minor", F.col("component") != F.col("major"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    bins = max(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_SHINGLES))
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    small = (F.col("blocks") == 1) & (F.col("others") == 1)
    shared = known.where(small).withColumns({"key": F.lit(-1).cast("long"), "i": F.pmod(F.xxhash64("grp"), F.lit(bins)).cast("int"), "j": F.lit(0)})
    large = known.where(~small)
    one = large.withColumns({"key": F.col("grp"), "i": place("blocks"), "j": F.explode(F.sequence(F.lit(0), F.col("others") - 1))})
    two = large.where("minor").withColumns({"key": F.col("grp"), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "j": place("others")})
    kept = ["key", "i", "j", "id", "n", "component", "buckets", "minor"]
    dealt = shared.select(kept).unionByName(one.select(kept)).unionByName(two.select(kept))
    full = dealt.join(sets.select(F.col("id").alias("sid"), "set"), F.col("id") == F.col("sid")).drop("sid")
    return full.groupBy("key", "i", "j").applyInArrow(lambda table: _shared(table, percent), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row; see the module's description."""
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return _named(df, key, text, shingle, percent, bands, rows)
    content = F.coalesce(F.col(text), F.lit(""))
    surrogate = F.lit(_NULL_BASE) + F.shiftrightunsigned(F.xxhash64(content), 3)
    source = df.select(F.coalesce(F.col(key).cast("long"), surrogate).alias("id"), content.alias("text"))
    signed = stored(_signed(source, shingle, bands, rows), "signatures")
    classes = cut(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")))

    own = signed.join(classes.withColumnsRenamed({"d1": "c1", "d2": "c2", "n": "cn"}), F.expr("id = rep AND d1 = c1 AND d2 = c2 AND n = cn"), "left_semi")
    buckets = own.select("id", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.max("id").alias("last"), F.min("id").alias("leader")).where("leader < last").drop("last")
    members = stored(buckets.join(shared, "bucket").select("bucket", "id", "n", "leader"), "buckets")

    ids = members.select(F.col("id").alias("wanted")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    sets = _sets(source.join(ids, F.col("id") == F.col("wanted"), "left_semi"), shingle)
    reps = classes.select(F.col("rep").alias("id"), "d1")
    sets = stored(sets.join(reps, ["id", "d1"], "left_semi").dropDuplicates(["id"]), "sets")

    sized = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    first = members.where("id != leader").join(members.where("id = leader").select("bucket", F.col("n").alias("m")), "bucket").where(sized)
    links = cut(_verified(first.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sets, percent))
    placed = cut(members.join(sized_components(links), "id", "left").select("bucket", "id", "n", "leader", F.coalesce("component", "id").alias("component")))
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    open_ = cut(placed.join(split, "bucket"))
    links = links.unionByName(_across(open_, sets, percent))
    labels = sized_components(links)

    rep = signed.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = rep.join(labels.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("c"))
    real = lambda c: F.when(F.col(c) < _NULL_BASE, F.col(c))
    return out.select(real("id").alias(key), F.col("n").alias("n_shingles"), real("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def _named(df: DataFrame, key: str, text: str, *settings: int) -> DataFrame:
    """``near_duplicates`` of a table whose ids are no whole numbers: by numbers in their stead."""
    told = df.select(F.col(key).alias("name"), F.col(text).alias("text"))
    numbered = keyed(told.where("name IS NOT NULL"), "name").unionByName(told.where("name IS NULL").withColumn(KEY, F.lit(None).cast("long")))
    found = cut(near_duplicates(numbered, KEY, "text", *settings))
    names = numbered.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("n"), "name").distinct()
    mine = found.join(names, F.col(KEY) == F.col("n"), "left").drop("n")
    least = mine.where("name IS NOT NULL").groupBy(F.col("component_id").alias("c")).agg(F.min("name").alias("least"))
    out = mine.join(least, F.col("component_id") == F.col("c"), "left")
    kept = F.coalesce(F.col("name") == F.col("least"), F.col("kept"))
    return out.select(F.col("name").alias(key), "n_shingles", F.col("least").alias("component_id"), kept.alias("kept"))
