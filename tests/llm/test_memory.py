"""What op2's steps hold at a time, and how many files its tables have: each file costs an executor several forks."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm import corpus as C
from scanloom.llm import chains, common, lm


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tables_between_passes_have_no_file_for_each_partition(spark, monkeypatch):
    made, put = [], {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(lm, "stored", lambda *a: made.append(common.stored(*a)) or made[-1])
    monkeypatch.setattr(lm, "discard", lambda df: None)
    texts = [(i, f"w{i} w{i % 7} a b w{i * 31 % 50}") for i in range(400)]
    docs = C.table(spark, texts).repartition(32).checkpoint()
    want = lm.score_table(docs, states=2, passes=1).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base")).collect()
    before = {k: spark.conf.get(k) for k in put}
    made.clear()
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        got = lm.score_table(docs, states=2, passes=1).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want) and len(got) == 400
    assert len(made) == 3 and all(len(t.inputFiles()) <= spark.sparkContext.defaultParallelism for t in made)


def test_wide_values_get_pages_of_their_own(spark):
    wide = spark.range(0, 40, 1, 1).select("id", F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 256), 8000)).alias("x"))
    table = common.stored(wide, "wide", common.WIDE)
    assert table.orderBy("id").collect() == wide.orderBy("id").collect()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (file,) = table.inputFiles()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
    try:
        assert reader.readOffsetIndex(reader.getFooter().getBlocks().get(0).getColumns().get(1)).getPageCount() >= 5  # 10 MB
    finally:
        reader.close()


def test_groups_of_segments_are_held_one_at_a_time():
    rng, k, chunk, words = np.random.default_rng(7), 8, 20_000, 50
    model = chains.Model(np.full(k, 1 / k), np.full((k, k), 1 / k), rng.random((words, k)))
    first = np.arange(0, 8 * chunk + 1, 100)
    tokens = rng.integers(0, words, first[-1]).astype(np.int32)
    array = chunk * k * 8
    assert _peak(lambda: chains.expected_counts(tokens, first, model, np.zeros((words, k)), chunk=chunk)) < 3.8 * array
    assert _peak(lambda: chains.log10_likelihood(tokens, first, model, chunk=chunk)) < 3.8 * array


def test_a_block_holds_little_besides_its_emissions():
    rng, words, states = np.random.default_rng(8), 200_000, 8
    counts, shares = rng.integers(0, 90, words), rng.integers(0, 1 << 16, (words, states)).astype(np.uint16)
    totals = lm.Totals(int((counts > 0).sum()), int(counts.sum()), counts @ shares.astype(np.int64))
    rows = [(1, np.arange(150_000, words)), (0, np.arange(150_000))]
    met = pa.table([
        pa.array([7, 7]), pa.array([p for p, _ in rows], pa.int32()), pa.array([(x - x[0]).astype(np.int32).tobytes() for _, x in rows]),
        pa.array([counts[x].tobytes() for _, x in rows]), pa.array([shares[x].tobytes() for _, x in rows]),
    ], names=["block", "part", "ids", "counts", "shares"])
    assert _peak(lambda: lm.Block(met, totals)) < 2.5 * words * states * 8
    block = lm.Block(met, totals)
    own = counts[:, None] * shares / totals.by_state
    want = (1 - lm.ADD / totals.whole) * ((1 - lm.MIX) * own + lm.MIX * counts[:, None] / totals.total)
    want[counts == 0] = lm.ADD / totals.whole
    assert np.allclose(block.emit, want, rtol=1e-12) and block.sizes.tolist() == [150_000, 50_000] and (block.counts == counts).all()
