"""Streams of scans: files of points with a ``scan_id`` arrive, each micro-batch is compared with a prepared reference.

No state passes from scan to scan, so there is no watermark. A micro-batch's result replaces what an earlier attempt at
the same batch wrote, so that a batch run again after a failure leaves one result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanloom import storage
from scanloom.operators import compare


def each_batch(reference: DataFrame, search: float, max_angle: float, out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: deviation summaries by scan_id. The reference's index is cached once for all batches."""
    index = compare.deviation_index(reference, search).persist()

    def write(batch: DataFrame, number: int) -> None:
        field = compare.deviation_field(batch, index, search, max_angle)
        compare.deviation_summary(field, ["scan_id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def summarize_stream(spark: SparkSession, folder: str, reference: DataFrame, search: float, max_angle: float, out: str, files_per_batch: int = 2) -> DataFrame:
    """Run through all files now in ``folder`` and return the summaries. A scan must lie in one file."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    state = storage.scratch(spark, "stream")
    query = stream.writeStream.foreachBatch(each_batch(reference, search, max_angle, out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
