"""Tables and archives between jobs, in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows in an Arrow batch: whole texts are in it, and a task has several batches in memory at once.
BATCH_ROWS = 2_000


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the session sets its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a new local one in local mode (as in tests), and an error elsewhere."""
    bounded(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.corpusmill.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.corpusmill.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove what save() wrote, once nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df._corpusmill_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Let Spark's cleaner delete shuffle files of finished jobs, which it does when the driver collects garbage."""
    import gc

    from pyspark import SparkContext

    gc.collect()
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context._jvm.System.gc()
