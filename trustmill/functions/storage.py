"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir); where a local session names none, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trustmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/trustmill-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and nothing is computed twice.

    The files stay until clear_saved(), since a lazy result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear_saved(spark: SparkSession) -> None:
    """Deletes what saved() has written in this application. Results that are still lazy can't be read afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
