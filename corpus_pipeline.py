"""The corpus pipeline: quality filter, near-dedup, decontamination, secret redaction, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run`` writes
each result as Parquet in the shared folder and reads it back as the next stage's input. The last stage adds the
training order (slot, offset) to every document. Every stage judges each row by its own id and text, so that rows without an id and
rows that share one are documents of their own; repeated rows with the same id and text count as one in near-dedup.

Defined results: null and empty texts score as quality does, have no duplicates, windows or secrets, and stay; texts of any length
are read whole; ties go as each operator says; an empty table passes through; other columns, whatever their names, are kept up to the last
stage, which replaces those of the names it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import common, decontamination, minhash, mixing, quality, secrets

ORACLE_SQL = None  # the classifier's fit and the sketches cannot be put in SQL; tests/llm hold the stages to brute force


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the classifier's threshold."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.keep_good(docs, quality.train(documents, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component (five-word shingles, similarity 0.8): that of the least id, of rows with
    the same id that of the least key. Of repeated rows with the same id and text the one that is least in all columns stays."""
    keyed = common.keyed(docs, "doc_id", "text")
    found = common.cut(minhash.near_duplicates(keyed, key=common.KEY).select(F.col(common.KEY).alias("k"), F.col("component_id").alias("c")).distinct())
    grouped = found.join(found.where("k <> c").select(F.col("c").alias("of")).distinct(), F.col("c") == F.col("of"), "left_semi")
    ids = keyed.select(common.KEY, "doc_id").join(grouped, F.col(common.KEY) == F.col("k"))
    first = ids.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first"))
    gone = ids.select("c", "k").distinct().join(first, "c").where("k <> first.k").select(F.col("k").alias("gone")).hint("shuffle_hash")
    return _one_each(keyed.join(gone, F.col(common.KEY) == F.col("gone"), "left_anti"))


def _one_each(keyed: DataFrame) -> DataFrame:
    """Of rows with the same key, the least. Keys that occur again are found by a narrow count; only their rows are dealt anew."""
    names = [c for c in keyed.columns if c != common.KEY]
    again = common.cut(keyed.groupBy(F.col(common.KEY).alias("again")).count().where("count > 1").select("again"))
    if not again.limit(1).count():
        return keyed.select(names)
    alone = keyed.join(again, F.col(common.KEY) == F.col("again"), "left_anti").select(names)
    same = keyed.join(again, F.col(common.KEY) == F.col("again"), "left_semi").groupBy(common.KEY).agg(F.min(F.struct(*names)).alias("row"))
    return alone.unionByName(same.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; rows are told apart by id and text."""
    key = F.struct(F.col("doc_id"), F.sha2("text", 256))
    found = decontamination.contamination(docs.withColumn(common.KEY, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=common.KEY)
    hit = found.where("n_hit > 0").select(F.col(common.KEY).alias("hit")).distinct().hint("shuffle_hash")
    return docs.join(hit, key.eqNullSafe(F.col("hit")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars set anew."""
    return secrets.redact_table(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
