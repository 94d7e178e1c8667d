"""Language-model scoring with a hidden Markov model.

Latent states emit words. Baum-Welch: each pass over the training texts computes expected counts of first states,
transitions and emissions by forward-backward; the counts are summed over all partitions and make the next model.
The scaled forward recursion then gives each text's exact log-probability.

Every training word has emissions of its own; no table of words is gathered or broadcast. Rows are kept in blocks of text, with
tokens as places in the block's own word list. A pass is two exchanges of packed arrays: a block sends, for each of
``parts`` parts of the vocabulary, its words' counts and the share of each state in them; a part adds these up over all blocks and
answers each block with its words' totals. Shares are 16-bit and counts whole numbers, so that the sums are exact and do not
depend on the order of blocks.

Emissions of state k: a known word w has (1 - MIX) * E_k(w) / E_k + MIX * c(w) / N of the mass that the base gives to known words;
a word that no training text has keeps the base's probability in every state. So each state is a distribution over the same
V + 1 words as the base.

Start: clusters of at most ``SAMPLE`` training texts of at most ``SAMPLE_BYTES`` (those of least hash) by their hashed words; each word
starts with the shares of its hash bucket. The passes that follow read all training texts.

Long texts are cut into segments that advance together (``chains``), so the recursions stay exact while memory is bounded
besides the tokens themselves.

Defined results: null text counts as empty and scores its end token alone; without training texts N, V and c are 0 and both scores
are 0; repeated rows are separate texts; a null id counts as the empty text in the fold rule; ties in the start's clusters go to the
first; columns of other names, whatever they are, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.chains import Model, expected_counts, log10_likelihood
from scanloom.llm.common import WIDE, ascii_bucket, discard, stored
from scanloom.llm.tokens import Words, mix, slices, split_words

FOLDS = 10
ADD = 0.1
STATES = 8
PASSES = 3
#: Weight of the unigram model in each state's emissions of known words.
MIX = 0.05
STAY = 0.98
SAMPLE, SAMPLE_BYTES = 1000, 64 << 10
BUCKETS = 1 << 14
SLICE_BYTES = 2 << 20
#: Text of one block of rows, and text of which one part of the vocabulary gets the words: parts grow with the corpus.
BLOCK_BYTES = 16 << 20
PART_BYTES = 64 << 20
#: Parts of the vocabulary of a small corpus, for each core.
PARTS_PER_CORE = 8
FULL = 65535
#: Blocks' counts of first states and transitions are added up in so many groups.
STAT_GROUPS = 64
#: Rows of arrays that are worked on at a time.
ROWS = 1 << 15
END = b""


# ---------------------------------------------------------------------------------- tokens of a block


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes of seven bits, the least first; small ones take one byte."""
    v = values.astype(np.uint32)
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - size
    for i in range(5):
        own = size > i
        if not own.any():
            break
        more = (size[own] > i + 1).astype(np.uint8) << 7
        out[starts[own] + i] = ((v[own] >> np.uint32(7 * i)) & np.uint32(127)).astype(np.uint8) | more
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = (raw[starts] & 127).astype(np.int32)
    for i in range(1, int(size.max()) if len(size) else 0):
        own = size > i
        out[own] |= (raw[starts[own] + i] & 127).astype(np.int32) << (7 * i)
    return out


def _bytes_of(words: Words, at: np.ndarray) -> pa.Array:
    """The words at places ``at``, as binary values."""
    lengths = words.ends[at] - words.starts[at]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    take = np.repeat(words.starts[at] - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(words.data[take])])


def _hash(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value, by its bytes alone (the word hashes of ``split_words``)."""
    out = np.zeros(len(words), dtype=np.uint64)
    full = np.flatnonzero(np.diff(np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1])) if len(words) else np.empty(0, np.int64)
    if len(full):
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(b" ", pa.binary()))[0].as_buffer()
        data = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, joined.size], dtype=np.int64)), joined)
        out[full] = split_words(data, lower=False).hashes
    return out


def encode(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of three kinds: texts (block, id, held_out, tokens), word lists (block, part, words, counts), and one row a block
    with the order in which its words were dealt to parts (in counts).

    A token is the place of its word in the block's list, most frequent first; the empty word ends each text.
    """

    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        listed: list[pa.Array] = []
        n_words = n_bytes = 0

        def closed(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            found = pa.chunked_array(listed, pa.binary()).combine_chunks().dictionary_encode()
            place, distinct = found.indices.to_numpy(), len(found.dictionary)
            listed.clear()
            counts = np.zeros(distinct, dtype=np.int64)
            trained = np.zeros(distinct, dtype=np.int64)
            for i, (batch, flat, ends) in enumerate(held):
                own = place[flat]
                held[i] = batch, own, ends
                counts += np.bincount(own, minlength=distinct)
                trains = ~batch.column("held_out").to_numpy(zero_copy_only=False)
                trained += np.bincount(own[np.repeat(trains, np.diff(ends))], minlength=distinct)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(distinct, dtype=np.int32)
            rank[order] = np.arange(distinct, dtype=np.int32)
            words = found.dictionary.take(pa.array(order))
            schema = pa.schema([("block", pa.int64()), ("id", id_type), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("part", pa.int32()), ("words", pa.list_(pa.binary())), ("counts", pa.binary())])
            for batch, own, ends in held:
                own = rank[own]
                n = batch.num_rows
                packed = pa.array([pack(own[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), batch.column("id"), batch.column("held_out"), packed, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.binary())], schema=schema)
            part = (_hash(words) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            which, first = np.unique(part[by], return_index=True)
            n = len(which)
            dealt = pa.array([by.astype(np.int32).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, f.type) for f in list(schema)[1:6]), dealt], schema=schema)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, distinct).astype(np.int32)), words.take(pa.array(by)))
            sums = trained[order][by].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(which.astype(np.int32)), lists, _blobs(sums, first[1:])], schema=schema)

        for batch in slices(batches, "text", SLICE_BYTES):
            id_type = batch.schema.field("id").type
            words = split_words(batch.column("text"), lower=True)
            _, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(words.counts + 1)])
            flat = np.full(int(ends[-1]), n_words, dtype=np.int32)  # the end is the slice's first word
            inside = np.ones(len(flat), dtype=bool)
            inside[ends[1:] - 1] = False
            flat[inside] = n_words + 1 + which
            held.append((batch.select(["id", "held_out"]).take(pa.array(np.arange(batch.num_rows))), flat, ends))  # a slice would hold the texts too
            listed += [pa.array([END], pa.binary()), _bytes_of(words, at)]
            n_words, n_bytes = n_words + 1 + len(at), n_bytes + len(words.data)
            if n_bytes >= BLOCK_BYTES:
                yield from closed(id_type)
                block, n_words, n_bytes = block + 1, 0, 0
                held.clear()
        if held:
            yield from closed(id_type)

    return rows.mapInArrow(run, f"block long, id {kind}, held_out boolean, tokens binary, part int, words array<binary>, counts binary")


# ---------------------------------------------------------------------------------- the start


def first_steps(states: int) -> tuple[np.ndarray, np.ndarray]:
    """Uniform first states and sticky transitions."""
    step = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(step, STAY if states > 1 else 1.0)
    return np.full(states, 1 / states), step


def first_shares(texts: list[str], states: int) -> np.ndarray:
    """(BUCKETS, states): the share of each state in the words of a hash bucket, from clusters of the texts by their words."""
    table = np.full((BUCKETS, states), 1.0 / states)
    words = split_words(pa.array(texts, pa.large_string()), lower=True)
    many = words.counts
    if states < 2 or not (many > 0).any():
        return table
    width = 1 << 10  # for the distances between texts
    owner = np.repeat(np.arange(len(many)), many)
    code = owner * width + (words.hashes % np.uint64(width)).astype(np.int64)
    x = np.sqrt(np.bincount(code, minlength=len(many) * width).reshape(len(many), width))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[int(np.argmax(many))]]  # the longest text, then always the one farthest from all before, weighed by its length
    for _ in range(states - 1):
        far = (1 - (x @ np.array(centres).T).max(axis=1)) * np.log1p(many)
        centres.append(x[int(np.argmax(far))])
    c = np.array(centres)
    for _ in range(10):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[near == j].sum(axis=0) for j in range(states)])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-9), c)
    bucket = (mix(words.hashes) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(bucket * states + near[owner], minlength=BUCKETS * states).reshape(BUCKETS, states).astype(float)
    share = (counts.sum(axis=0) + 1) / (counts.sum() + states)
    smooth = counts + 0.5 * share
    return smooth / smooth.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------------------------- passes

_UP = "part int, block long, ids binary, counts binary, shares binary"
_DOWN = "block long, part int, ids binary, counts binary, shares binary"


def _some(n: int) -> Iterator[slice]:
    """All of ``n`` rows, some at a time: what is computed from them besides the result stays small."""
    yield from (slice(a, a + ROWS) for a in range(0, n, ROWS))


def _quantised(shares: np.ndarray) -> np.ndarray:
    out = np.empty(shares.shape, dtype=np.uint16)
    for at in _some(len(shares)):
        out[at] = np.rint(shares[at] * FULL)
    return out


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.split(values, cuts)], pa.binary())


def _numbers(column: pa.ChunkedArray, kind: type, width: int = 1) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=kind).reshape(-1, width) if width > 1 else np.frombuffer(x.as_buffer(), dtype=kind) for x in column]


def _answer(blocks: np.ndarray, part: int, ids: list[np.ndarray], counts: np.ndarray, shares: np.ndarray) -> pa.Table:
    """A part's rows to the blocks, and one (block -1) with its totals: words, count, counts by state."""
    known = counts > 0
    totals = np.concatenate([[known.sum(), counts.sum()], counts @ shares.astype(np.int64)]).astype(np.int64)
    n = len(blocks)
    return pa.table([
        pa.array(np.append(blocks, -1)), pa.array(np.full(n + 1, part, dtype=np.int32)), pa.array([*(x.tobytes() for x in ids), b""], pa.binary()),
        pa.array([*(counts[x].tobytes() for x in ids), totals.tobytes()], pa.binary()), pa.array([*(shares[x].tobytes() for x in ids), b""], pa.binary()),
    ], names=["block", "part", "ids", "counts", "shares"])


def _listed(encoded: DataFrame, table: Broadcast) -> DataFrame:
    """The first answer: words get their numbers, counts and first shares."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        words = rows["words"].combine_chunks()
        flat = words.values if isinstance(words, pa.ListArray) else pa.chunked_array([c.values for c in words.chunks]).combine_chunks()
        sizes = np.array([len(x) for x in rows["words"]], dtype=np.int64)
        found = flat.dictionary_encode()
        place = found.indices.to_numpy().astype(np.int32)
        counts = np.zeros(len(found.dictionary), dtype=np.int64)
        np.add.at(counts, place, np.concatenate(_numbers(rows["counts"], np.int32)))
        bucket = (mix(_hash(found.dictionary)) % np.uint64(BUCKETS)).astype(np.int64)
        return _answer(rows["block"].to_numpy(), part, np.split(place, np.cumsum(sizes)[:-1]), counts, _quantised(table.value)[bucket])

    return encoded.select("part", "block", "words", "counts").where("part IS NOT NULL").groupBy("part").applyInArrow(run, _DOWN)


def _merged(up: DataFrame, states: int) -> DataFrame:
    """Counts of all blocks added up: by word for the parts, and those of states (part below 0)."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        if part < 0:
            total = np.sort(np.stack(_numbers(rows["counts"], np.float64)), axis=0).sum(axis=0)
            return pa.table([pa.array([-2], pa.int64()), pa.array([part], pa.int32()), pa.array([b""]), pa.array([total.tobytes()]), pa.array([b""])], names=["block", "part", "ids", "counts", "shares"])
        ids = _numbers(rows["ids"], np.int32)
        flat, n = np.concatenate(ids), np.concatenate(_numbers(rows["counts"], np.int32)).astype(np.float64)
        shares = np.concatenate(_numbers(rows["shares"], np.uint16, states))
        size = int(flat.max()) + 1 if len(flat) else 0
        counts = np.bincount(flat, weights=n, minlength=size)
        found = np.column_stack([np.bincount(flat, weights=n * shares[:, k], minlength=size) for k in range(states)])
        found /= np.maximum(found.sum(axis=1, keepdims=True), 1e-9)
        return _answer(rows["block"].to_numpy(), part, ids, counts.astype(np.int64), _quantised(found))

    return up.groupBy("part").applyInArrow(run, _DOWN)


class Totals:
    """V, N and each state's sum of counts."""

    def __init__(self, distinct: int, total: int, by_state: np.ndarray) -> None:
        self.distinct, self.total, self.by_state = distinct, total, by_state.astype(float)
        self.whole = total + ADD * (distinct + 1)

    @classmethod
    def of(cls, down: DataFrame, states: int) -> Totals:
        """From the parts' answers: one row of numbers a part."""
        rows = np.zeros(2 + states, dtype=np.int64)
        for x in down.where("block = -1").select("counts").toArrow()["counts"]:
            rows += np.frombuffer(x.as_buffer(), dtype=np.int64)
        return cls(int(rows[0]), int(rows[1]), rows[2:])


class Block:
    """A block's words: base probabilities, emissions, counts over the corpus, and how they are dealt to parts."""

    def __init__(self, met: pa.Table, totals: Totals) -> None:
        states = len(totals.by_state)
        by = np.argsort(met["part"].to_numpy(), kind="stable").tolist()
        sorted_numbers = lambda *a: (lambda found: [found[i] for i in by])(_numbers(*a))
        ids = sorted_numbers(met["ids"], np.int32)
        self.parts, self.sizes = met["part"].to_numpy()[by], np.array([len(x) for x in ids], dtype=np.int64)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.counts = np.concatenate(sorted_numbers(met["counts"], np.int64)) if ids else np.empty(0, np.int64)
        shares = np.concatenate(sorted_numbers(met["shares"], np.uint16, states)) if ids else np.empty((0, states))
        self.base = (self.counts + ADD) / totals.whole
        mass = 1 - ADD / totals.whole  # of known words
        empty = totals.by_state <= 0
        self.emit = np.empty((len(self.counts), states))
        for at in _some(len(self.counts)):
            counts = self.counts[at, None]
            own = counts * shares[at] / np.maximum(totals.by_state, 1.0)
            flat = counts / max(1, totals.total)
            self.emit[at] = mass * np.where(empty, flat, (1 - MIX) * own + MIX * flat)
        self.emit[self.counts == 0] = ADD / totals.whole


def _tokens(rows: pa.Table, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens, as places among the parts' words, and where each text's begin."""
    packed = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in rows["tokens"] if x.is_valid]
    first = np.concatenate([[0], np.cumsum([np.count_nonzero(x < 128) for x in packed])]).astype(np.int64)
    out = np.empty(int(first[-1]), dtype=np.int32)
    for x, a, b in zip(packed, first[:-1].tolist(), first[1:].tolist()):
        out[a:b] = place[unpack(x)]
    return out, first


def _sums(values: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the tokens' ``values`` for each text, some texts at a time."""
    out = np.empty(len(first) - 1, dtype=values.dtype)
    many = first[:-1] // ROWS
    edges = np.concatenate([[0], np.flatnonzero(np.diff(many)) + 1, [len(out)]]).tolist() if len(out) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        out[a:b] = np.add.reduceat(values[tokens[first[a] : first[b]]], first[a:b] - first[a])
    return out


def _times(tokens: np.ndarray, distinct: int) -> np.ndarray:
    """How often each word occurs."""
    out = np.zeros(distinct, dtype=np.int32)
    for a in range(0, len(tokens), step := max(ROWS, distinct)):
        out += np.bincount(tokens[a : a + step], minlength=distinct).astype(np.int32)
    return out


def _opened(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's texts without their tokens, and for each word of its list the place among the parts' words."""
    texts = rows.select(["id", "held_out"]).filter(rows["tokens"].is_valid())
    (dealt,) = _numbers(rows["counts"].drop_null(), np.int32)
    place = np.empty(len(dealt), dtype=np.int32)
    place[dealt] = np.arange(len(dealt), dtype=np.int32)
    return texts, place


def _expect(sent: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block's expected counts: a row for each part of the vocabulary, and one of states and transitions."""

    def expect(rows: pa.Table, met: pa.Table) -> pa.Table:
        start, step, totals = sent.value
        states, number = len(start), rows["block"][0].as_py()
        block = Block(met, totals)
        tokens, first = _tokens(rows, _opened(rows)[1])
        emissions = np.zeros((len(block.base), states))
        opened, pairs = expected_counts(tokens, first, Model(start, step, block.emit), emissions)
        trained = _times(tokens, len(block.base))
        emissions /= np.maximum(emissions.sum(axis=1, keepdims=True), 1e-300)
        shares = _quantised(emissions)
        cuts = np.cumsum(block.sizes)[:-1]
        more = np.concatenate([opened, pairs.ravel()])
        return pa.table([
            pa.array(np.append(block.parts, -1 - number % STAT_GROUPS).astype(np.int32)), pa.array(np.full(len(block.parts) + 1, number)),
            pa.array([*_blobs(block.ids, cuts).to_pylist(), b""], pa.binary()), pa.array([*_blobs(trained, cuts).to_pylist(), more.tobytes()], pa.binary()),
            pa.array([*_blobs(shares, cuts).to_pylist(), b""], pa.binary()),
        ], names=["part", "block", "ids", "counts", "shares"])

    return expect


def _by_block(rows: DataFrame, down: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("block").cogroup(down.where("block >= 0").groupBy("block")).applyInArrow(function, schema)


def _scored(sent: Broadcast, learned: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, met: pa.Table) -> pa.Table:
        start, step, totals = sent.value
        block = Block(met, totals)
        texts, place = _opened(rows)
        tokens, first = _tokens(rows, place)
        n = texts.num_rows
        base = _sums(np.log10(block.base), tokens, first)
        known = _sums((block.counts > 0).astype(np.int64), tokens, first)
        likely = log10_likelihood(tokens, first, Model(start, step, block.emit)) if learned else np.zeros(n)
        return pa.table([texts["id"], texts["held_out"], pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(likely)], names=["id", "held_out", "n_tokens", "n_known", "base", "likely"])

    return run


def score_table(df: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), (ascii_bucket(key, FOLDS) == 0).alias("held_out"), F.col(text).alias("text"))
    size = rows.agg(F.count_if(~F.col("held_out")).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # tables are written by no more tasks than there are blocks or cores: input splits and shuffle partitions can be far more, each a file
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, -(-size["bytes"] // BLOCK_BYTES))
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * cores), -(-size["bytes"] // PART_BYTES))
    encoded = stored(encode(rows.coalesce(tasks), parts), "blocks", WIDE)
    texts = encoded.where("part IS NULL").select("block", "id", "held_out", "tokens", "counts")
    training = texts.where("held_out IS NULL OR NOT held_out")

    hashed = F.xxhash64("id", "text")
    drawn = F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE / max(1, size["n"])))
    sample = rows.where("NOT held_out").where((F.octet_length("text") <= SAMPLE_BYTES) & drawn).orderBy(hashed, "text").limit(SAMPLE).select("text").toArrow()
    table = spark.sparkContext.broadcast(first_shares(sample["text"].to_pylist(), states))
    down = stored(_listed(encoded, table).coalesce(tasks), "words", WIDE)
    totals = Totals.of(down, states)
    start, step = first_steps(states)
    for _ in range(passes if totals.total else 0):
        sent = spark.sparkContext.broadcast((start, step, totals))
        up = _by_block(training, down, _expect(sent), _UP)
        before, down = down, stored(_merged(up, states).coalesce(tasks), "pass", WIDE)
        found = down.where("block = -2").select("counts").toArrow()["counts"]  # at most STAT_GROUPS rows
        more = np.sort([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in found], axis=0).sum(axis=0)
        start, step = more[:states] + 1.0, more[states:].reshape(states, states) + 1.0
        start, step = start / start.sum(), step / step.sum(axis=1, keepdims=True)
        totals = Totals.of(down, states)
        del up
        discard(before)
    sent = spark.sparkContext.broadcast((start, step, totals))
    kind = rows.schema["id"].dataType.simpleString()
    scored = _by_block(texts, down, _scored(sent, totals.total > 0), f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, likely double")
    return scored.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(totals.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("likely").alias("score"))
