"""Where drained streams and written tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; only a local session without one (a test) gets a local folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", ""):
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all input there is now, into a Parquet table, and returns that table."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
