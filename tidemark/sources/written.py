"""Tables that a job writes for itself in the shared folder, so that lost executors and repeated reads cost nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.sinks import shared_folder


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    path = path or f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end."""
    return exists(spark, f"{path}/_SUCCESS")
