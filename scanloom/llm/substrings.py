"""Substring dedup by seed and extend.

Seeds: every window of ``span`` words holds ``span - K + 1`` runs of K words; the one with the least hash is the window's
anchor (winnowing), so equal windows have equal anchors and any shared span of ``span`` words shares one.
Join: anchors are counted over the whole corpus; those that occur twice form a bitmap of bounded size that
only spares work: a full bitmap lets every window through and changes no result.
Extend: every window around a repeated anchor, at each reach to the left and right, is joined on a 96-bit hash of all
its words. The words covered by windows found twice are the maximal repeats of at least ``span`` words.

Equal windows inside one block of text are settled there and leave one witness, so a passage that many
documents share costs a row per block, not a row per document, in the shuffle. No pairs are formed.

Defined results: null text, or text without words, has no words and keeps the empty string's digest; texts shorter than
``span`` keep all words; rows with the same id and text get the same result, and each of them counts as an
occurrence; a null id is kept; ids may be whole numbers or text; texts of any length are read whole; rows that share an id are told apart
by 16 bits of their texts' hash where ids are numbers; columns of other names are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from scanloom.llm.common import KEY, cut, keyed
from scanloom.llm.tokens import Words, grams, slices, split_words

SPAN = 35
K = 11
SLICE_BYTES = 8 << 20
#: Kinds of rows between the scan and the join.
WINDOW, WITNESS, RUN = 0, 1, 2
#: The bitmap of repeated anchors has so many bits for each anchor, and at most so many in all (16 MB).
BITS_PER_ANCHOR = 16
MAX_BITS = 1 << 27


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best() over every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = best(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(words: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor hash, whether the window lies in one text, and the hashes of the selected runs (one each)."""
    n = len(words.hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64)
    runs, _ = grams(words, k)
    width = span - k + 1
    least = _slide(runs, width, np.minimum)
    limit = np.repeat(words.first[1:], words.counts)[:n]
    valid = np.arange(n) + span <= limit
    padded = np.zeros(n + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1 : width - 1 + n] = np.where(valid, least, 0)
    selected = runs[_slide(padded, width, np.maximum) == runs]
    return least, valid, selected


def _repeated(rows: DataFrame, span: int, k: int) -> DataFrame:
    """Anchors selected at two positions or more."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            _, _, selected = anchors(split_words(batch.column("text"), lower=False), span, k)
            values, counts = np.unique(selected, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["anchor", "n"])

    counted = rows.select("text").mapInArrow(select, "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _bitmap(repeated: DataFrame) -> Broadcast:
    """At most MAX_BITS bits, one set for each repeated anchor, sent to the workers."""
    count = repeated.count()
    bits = min(MAX_BITS, 1 << max(16, (BITS_PER_ANCHOR * max(count, 1) - 1).bit_length()))
    slots = repeated.select(F.expr(f"shiftrightunsigned(anchor, 6) & {bits // 64 - 1}L").alias("slot"), F.expr("shiftleft(1L, CAST(anchor & 63 AS INT))").alias("bit"))
    table = slots.groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    mask = np.zeros(bits // 64, dtype=np.uint64)
    mask[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return repeated.sparkSession.sparkContext.broadcast(mask)


def _windows(rows: DataFrame, bitmap: Broadcast, span: int, k: int) -> DataFrame:
    """Rows (h1, h2, id, at). ``at`` packs the text's hash, the kind of row and a position; see ``at``.

    A window to be settled has its 96-bit hash; a witness has no place of its own; a run of starts known
    to repeat has its length in h2 and is spread by h1.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bitmap.value
        for batch in slices(batches, "text", SLICE_BYTES):
            words = split_words(batch.column("text"), lower=False)
            least, valid, _ = anchors(words, span, k)
            slot = ((least >> np.uint64(6)) & np.uint64(len(mask) - 1)).astype(np.int64)
            at = np.flatnonzero(valid & ((mask[slot] >> (least & np.uint64(63))) & np.uint64(1)).astype(bool))
            if not len(at):
                continue
            h1, h2 = grams(words, span, 0)[0][at], grams(words, span, 1)[0][at]
            order = np.argsort(h1, kind="stable")
            a, b = h1[order], h2[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            again = np.concatenate([[False], same])
            more = np.concatenate([same, [False]])
            single = order[~again & ~more]
            witness = order[~again & more]
            known = np.sort(at[order[again | more]])
            text = np.repeat(np.arange(batch.num_rows), words.counts)
            breaks = np.ones(len(known), dtype=bool)
            breaks[1:] = (np.diff(known) != 1) | (text[known[1:]] != text[known[:-1]])
            heads = np.flatnonzero(breaks)
            lengths = np.diff(np.append(heads, len(known)))
            owner = np.concatenate([text[at[single]], text[at[witness]], text[known[heads]]])
            start = np.concatenate([at[single], at[witness], known[heads]]) - words.first[owner]
            kind = np.repeat([WINDOW, WITNESS, RUN], [len(single), len(witness), len(heads)])
            spread = np.concatenate([h1[single], h1[witness], words.hashes[known[heads]] ^ known[heads].astype(np.uint64)])
            second = np.concatenate([(h2[single] >> np.uint64(32)).astype(np.int64), (h2[witness] >> np.uint64(32)).astype(np.int64), lengths])
            r = batch.column("r").to_numpy().astype(np.int64)[owner]
            columns = [pa.array(spread.view(np.int64)), pa.array(second), batch.column("id").take(pa.array(owner)), pa.array((r << 44) | (kind << 42) | start)]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "id", "at"])

    return rows.mapInArrow(emit, "h1 long, h2 long, id long, at long")


def _kept(rows: DataFrame, span: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of each text given the starts of its repeated windows as masks of 64 positions."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, masks in zip(batch.column("text"), batch.column("masks")):
                words = (text.as_py() or "").encode().split()
                n, masks = len(words), masks.as_py()
                if masks:
                    starts = np.concatenate([64 * m["block"] + np.flatnonzero(np.unpackbits(np.array([m["bits"]], dtype="<i8").view(np.uint8), bitorder="little")) for m in masks])
                    change = np.zeros(n + span + 64, dtype=np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + span, -1)
                    gone = np.cumsum(change)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((n, n - len(words), b" ".join(words).decode()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "masks").mapInArrow(remove, "id long, n_words long, n_removed long, kept string")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(key, n_words, n_removed, kept) for each row: ``kept`` is the words outside repeats, joined by one space."""
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        numbered = keyed(df.select(F.col(key).alias("name"), F.col(text).alias("text")), "name", "text")
        names = numbered.select(F.col(KEY).alias("n"), "name").distinct()
        found = remove_repeats(numbered, KEY, "text", span, k)
        return found.join(names, F.col(KEY) == F.col("n")).select(F.col("name").alias(key), *found.columns[1:])
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.hash(text).bitwiseAND(F.lit(0xFFFF)).alias("r"))
    bitmap = _bitmap(cut(_repeated(rows, span, k)))
    found = _windows(rows, bitmap, span, k).withColumn("n", F.count("*").over(Over.partitionBy("h1", "h2")))
    kind = F.shiftright("at", 42).bitwiseAND(F.lit(3))
    first, text_hash = F.col("at").bitwiseAND(F.lit((1 << 42) - 1)), F.shiftright("at", 44)
    runs = found.where((kind == RUN) | (kind == WINDOW) & (F.col("n") > 1))
    starts = runs.select("id", text_hash.alias("r"), F.explode(F.sequence(first, first + F.when(kind == RUN, F.col("h2") - 1).otherwise(0))).alias("pos"))
    # a text's block of 64 positions: its hash and the block's number in one long
    block = F.shiftleft("r", 40).bitwiseOR(F.shiftright("pos", 6))
    bits = starts.groupBy("id", block.alias("block")).agg(F.expr("bit_or(shiftleft(1L, CAST(pos & 63 AS INT)))").alias("bits"))
    masks = bits.groupBy(F.col("id").alias("i"), F.shiftright("block", 40).cast("int").alias("q")).agg(F.collect_list(F.struct(F.col("block").bitwiseAND(F.lit((1 << 40) - 1)).alias("block"), "bits")).alias("masks"))
    marked = rows.join(masks.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("r") == F.col("q")), "left")
    return _kept(marked, span).withColumnRenamed("id", key)


