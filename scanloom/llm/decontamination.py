"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item; an item with fewer is one window. The fingerprint of a window is the least hash
of its runs of ``GRAM`` words: the minimum k-gram hash per sliding window, kept on both sides. Neighbouring windows mostly have the same
least run, so a document is probed only where its fingerprint changes: a probe stands for all windows until the next one. Probes are joined
with the items' fingerprints as they stream out of the scan; the windows of the hits are then extended to all their words and joined
with the distinct item windows. A shared span of ``WINDOW`` words always has an equal fingerprint, so none is missed, and
the join on words leaves no false hit. Items shorter than a window go in classes by their length, each with its own
probes, in the same scan.

Occurrences carry a key of the set of items that share a window; the items themselves come in once for each document and set.

The item side is broadcast while its windows take at most ``BROADCAST_BYTES``; beyond that the fingerprints are joined by a
shuffle of (id, places, fingerprint), and the windows of the hits are cut from the texts again.

Words are compared in a form that lower-cases A-Z only: non-ASCII texts are read as Latin-1 bytes first, which maps
distinct words to distinct words.

Defined results: null text has no words; null item text has no windows; an item id that occurs twice counts once; a null item id
takes no part in the list of items, but its windows hit; very long texts are read whole, in memory of some hundred bytes a word; rows with the
same id and text get the same result, rows of one id are told apart by length and hash of their text, and ids may be of any type, null
included; equal least hashes in a window count as one fingerprint; columns of other names are not looked at; empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import stored

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 64 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")))
    return F.coalesce(F.array_remove(F.split(plain, SEPARATORS), ""), F.array().cast("array<string>"))


def _joined(a: str, b: str, shift: int, function: str) -> str:
    """function(x, y) of a's elements and those of b that stand ``shift`` places later, as far as both go."""
    n = f"greatest(least(size({a}), size({b}) - {shift}), 0)"
    return f"zip_with(slice({a}, 1, {n}), slice({b}, {shift + 1}, {n}), (x, y) -> {function})"


def _doubled(df: DataFrame, first: str, width: int, function: str, name: str) -> tuple[DataFrame, str]:
    """A column of function() over every ``width`` neighbours of an array, by doubling; runs of hashes must not overlap, so
    what is left over is added place by place."""
    have, column, powers = 1, first, {1: first}
    while have * 2 <= width:
        df = df.withColumn(f"{name}{have * 2}", F.expr(_joined(column, column, have, function)))
        have, column = have * 2, f"{name}{have * 2}"
        powers[have] = column
    rest = width - have
    while rest:
        part = max(p for p in powers if p <= rest)
        df = df.withColumn(f"{name}{have + part}", F.expr(_joined(column, powers[part], have, function)))
        have, column, rest = have + part, f"{name}{have + part}", rest - part
    return df, column


def _probed(df: DataFrame, window: int, gram: int, tag: str) -> tuple[DataFrame, str]:
    """A column of probes (s, e, fp) of the array of words w: windows s to e - 1 have the fingerprint fp."""
    gram = min(gram, window)
    df, runs = _doubled(df, "h", gram, "xxhash64(x, y)", f"g{tag}_")
    # nothing may filter by these columns below an explode: pushed down, each of them would be written out anew at every use
    df, least = _doubled(df, runs, window - gram + 1, "least(x, y)", f"m{tag}_")
    n = f"size({least})"
    places = f"IF({n} > 0, filter(sequence(0, {n} - 1), i -> i = 0 OR get({least}, i) <> get({least}, i - 1)), CAST(array() AS array<int>))"
    df = df.withColumn(f"p{tag}", F.expr(places))
    probes = f"transform(p{tag}, (s, k) -> named_struct('m', {window}, 's', s, 'e', coalesce(get(p{tag}, k + 1), {n}), 'fp', get({least}, s)))"
    return df.withColumn(f"probes{tag}", F.expr(probes)), f"probes{tag}"


def _lists(df: DataFrame, lengths: list[int], gram: int) -> tuple[DataFrame, Column]:
    df = df.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    columns = []
    for m in lengths:
        df, column = _probed(df, m, gram, str(m))
        columns.append(column)
    return df, F.concat(*(F.col(c) for c in columns))


def _wanted(items: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """Distinct item windows (m, window, fp) with the set of their items and its key."""
    df, probes = _lists(items, lengths, gram)
    rows = df.select("item", "w", F.explode_outer(probes).alias("p")).where(f"p.m = least(size(w), {window})")
    cut_out = rows.select("item", F.col("p.m").alias("m"), F.col("p.fp").alias("fp"), "w", F.explode_outer(F.expr("sequence(p.s, p.e - 1)")).alias("s"))
    windows = cut_out.select("item", "m", "fp", F.expr("slice(w, s + 1, m)").alias("window"))
    sets = windows.groupBy("m", "window", "fp").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.withColumn("set", F.sha2(F.to_json("items"), 256))


def _occurrences(docs: DataFrame, wanted: DataFrame, lengths: list[int], gram: int, broadcast: bool) -> DataFrame:
    """(id, r, s, m, set, n_words): a row for each occurrence of an item window, and one with s = -1 for each document."""
    prints = wanted.select(F.col("m").alias("pm"), F.col("fp").alias("p")).distinct()
    windows = wanted.select(F.col("m").alias("wm"), F.col("window").alias("same"), "set")
    hashed, probes = _lists(docs, lengths, gram)
    entry = "named_struct('m', -1, 's', -1, 'e', 0, 'fp', CAST(NULL AS BIGINT))"  # the document itself
    met = (F.col("p.m") == F.col("pm")) & (F.col("p.fp") == F.col("p_"))
    prints = prints.withColumnRenamed("p", "p_")
    if broadcast:
        listed = hashed.withColumn("listed", F.concat(F.expr(f"array({entry})"), probes)).select("id", "r", "w", "listed")
        seeds = listed.select("id", "r", "w", F.explode_outer("listed").alias("p")).join(F.broadcast(prints), met, "left").where("p.s < 0 OR p_ IS NOT NULL")
        windows = F.broadcast(windows)
    else:
        listed = hashed.withColumn("listed", probes).select("id", "r", "listed")
        found = listed.select("id", "r", F.explode_outer("listed").alias("p")).join(prints, met, "left_semi").groupBy(F.col("id").alias("i"), F.col("r").alias("q")).agg(F.collect_set("p").alias("found"))
        none = F.expr("CAST(array() AS array<struct<m: int, s: int, e: int, fp: bigint>>)")
        joined = docs.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("r") == F.col("q")), "left")
        seeds = joined.select("id", "r", "w", F.explode_outer(F.concat(F.expr(f"array({entry})"), F.coalesce("found", none))).alias("p"))
    grown = seeds.select("id", "r", "w", F.col("p.m").alias("m"), F.explode_outer(F.expr("IF(p.s < 0, array(-1), sequence(p.s, p.e - 1))")).alias("s"))
    cut_out = grown.select("id", "r", "m", "s", F.size("w").alias("n_words"), F.expr("IF(s >= 0, slice(w, s + 1, m), NULL)").alias("window"))
    hits = cut_out.join(windows, (F.col("m") == F.col("wm")) & (F.col("window") == F.col("same")), "left")
    return hits.where("s < 0 OR set IS NOT NULL").select("id", "r", "s", "m", "set", "n_words")


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, n_words, n_hit, n_items, items) for each row; ``items`` are the ids as text, sorted."""
    told = F.struct(F.xxhash64(text), F.coalesce(F.octet_length(text), F.lit(-1)))
    docs = df.select(F.col(key).alias("id"), told.alias("r"), words_of(F.col(text)).alias("w"))
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where("size(w) > 0")
    # each word is in at most ``window`` windows; 100 bytes stand for what else a window's row has
    taken = F.sum((F.octet_length(F.array_join("w", " ")) + 100 * F.size("w")) * F.least(F.size("w"), F.lit(window)))
    found = items.groupBy(F.least(F.size("w"), F.lit(window)).alias("m")).agg(taken.alias("bytes")).collect()  # at most ``window`` rows
    lengths = sorted(x["m"] for x in found)
    if not lengths:
        return docs.select(F.col("id").alias(key), F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    wanted = stored(_wanted(items, lengths, window, gram), "items")
    met = stored(_occurrences(docs, wanted, lengths, gram, sum(x["bytes"] for x in found) <= broadcast_bytes), "hits")

    marked = met.where("s >= 0").select("id", "r", "s", "m").distinct()
    earlier = Window.partitionBy("id", "r").orderBy("s", "m").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("s") + F.col("m")).over(earlier), F.lit(0))
    own = marked.select("id", "r", F.greatest(F.col("s") + F.col("m") - F.greatest("s", reached), F.lit(0)).alias("n"))
    n_hit = own.groupBy("id", "r").agg(F.sum("n").alias("n_hit"))
    sets = wanted.select(F.col("set").alias("of"), "items").dropDuplicates(["of"])
    named = met.where("s >= 0").select("id", "r", "set").distinct().join(sets, F.col("set") == F.col("of")).groupBy(F.col("id").alias("i"), F.col("r").alias("q"))
    named = named.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("r") == F.col("q"))
    hit = n_hit.join(named, same).select(F.col("i").alias("j"), F.col("q").alias("t"), "n_hit", "items")
    every = met.where("s < 0").select("id", "r", F.col("n_words").cast("long").alias("n_words"))
    out = every.join(hit, F.col("id").eqNullSafe(F.col("j")) & (F.col("r") == F.col("t")), "left")
    empty = F.array().cast("array<string>")
    return out.select(F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", empty).alias("items"))
