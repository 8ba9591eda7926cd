"""Tables that cut long lineages, written to the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir()."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise RuntimeError("set spark.checkpoint.dir, or call SparkContext.setCheckpointDir(), with a folder that driver and executors share")
    return found.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """Path of a new table in the shared folder; it goes when the application ends, if not before."""
    path = f"{shared_dir(spark)}/feedweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def by_merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that is done by sort and merge. The size of a written table says little about its rows: those of alike
    pages take hundreds of times their compressed size, and a table that is small by its files would go whole through the driver."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
