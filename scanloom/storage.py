"""The folder that all executors share, and ways to end a plan's lineage there."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temp folder only where it is unset and all tasks run in this process (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="scanloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/scanloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


#: For tables with values of 100 KB and more: a page's size is looked at after each row, where Parquet waits for 100 of them and then
#: holds, compresses and reads back all that as one page.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.check.estimate": "false"}


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there. ``options`` are the writer's."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``stored`` that nothing will read again, and what the JVM still holds of past shuffles."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        table = jvm.org.apache.hadoop.fs.Path(file).getParent()
        table.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(table, True)
    swept(df.sparkSession)


def swept(spark: SparkSession) -> None:
    """Let Spark drop the files of shuffles that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark drops its files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
