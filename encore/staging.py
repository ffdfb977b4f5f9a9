"""Cut lineage through tables in the cluster's shared folder.

A staged table is plain Parquet below `spark.checkpoint.dir`, so any executor can read it and a
lost executor costs only the tasks it was running. The folder is set here only when the session
has none (single-machine tests)."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='encore-')}"
        spark.sparkContext.setCheckpointDir(found)
        return shared_dir(spark)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back; removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/encore/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again, and shuffle files with them.

    Spark removes shuffle files of finished plans only when the JVM collects garbage, which a
    driver with little to do puts off; asking for it here keeps the disks from filling."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if frames:
        free_shuffles(frames[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
