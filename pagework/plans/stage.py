"""Tables written once and read many times by later steps of a job.

The folder is the one the cluster names in ``spark.checkpoint.dir``, which all
executors share, so losing an executor never loses a staged table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when the input has fewer splits than the session has
    cores (a small table).  Inputs with enough splits, which is every large
    one, are read in place without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


# Whole pages are long rows, so few of them make an Arrow batch.
PAGES_PER_BATCH, BYTES_PER_BATCH = 256, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that the boxes of its pages fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagework/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
