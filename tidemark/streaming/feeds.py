"""Streams over event tables: the log's tail, idempotent feeds and shared context; see ``ordered`` for those with timers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import shared_folder


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream; naive timestamps become UTC instants, which watermarks need.

    The path is given as a pattern, since a stream's plain path must be a folder.
    """
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema.fields))


def tail_log(spark: SparkSession, path: str, schema: str, artifact_type: str | None = None, date: str | None = None) -> DataFrame:
    """New lines of the event log, filtered by type and date (partitions)."""
    rows = spark.readStream.schema(schema).json(path)
    rows = rows if artifact_type is None else rows.where(F.col("artifact_type") == artifact_type)
    return rows if date is None else rows.where(F.col("date") == date)


def dedup_feed(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first copy of each id within the watermark; state older than it is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


PLACES = "bucket int, batch long"


def places(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The batch that last wrote each bucket, as of a batch: one row a bucket."""
    return {row["bucket"]: row["batch"] for row in spark.read.schema(PLACES).parquet(f"{path}/places/{number}").collect()} if number >= 0 else {}


def read_buckets(spark: SparkSession, path: str, where: dict[int, int], schema: StructType) -> DataFrame:
    folders = [f"{path}/rows/{batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replacing_feed(rows: DataFrame, path: str, keys: tuple[str, ...], sequence: str, checkpoint: str | None = None, buckets: int = 64):
    """Starts a stream that keeps the last write of each key under ``path``; ``feed_snapshot`` reads it as of a batch.

    Keys are dealt into ``buckets`` by hash. A batch reads and rewrites only the buckets that it has keys of, then notes
    where each bucket is; a batch that is run again replaces its own. With a ``checkpoint`` folder of its own, which
    belongs to this path, a stream goes on where it ended.
    """
    from ..sources.store import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        known = places(spark, path, number - 1)
        touched = {row["bucket"] for row in batch.select(bucket).distinct().collect()}  # at most ``buckets`` rows
        old = read_buckets(spark, path, {b: n for b, n in known.items() if b in touched}, batch.schema)
        merged = upsert(old, batch, keys, sequence).select("*", bucket)
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/{number}")
        spark.createDataFrame(list((known | dict.fromkeys(touched, number)).items()), PLACES).coalesce(1).write.mode("overwrite").parquet(f"{path}/places/{number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or f"{path}-state-{uuid.uuid4().hex}").trigger(availableNow=True).start()


def feed_snapshot(spark: SparkSession, path: str, number: int, schema: StructType) -> DataFrame:
    """The rows of a replacing feed after a batch."""
    return read_buckets(spark, path, places(spark, path, number), schema)


def context_feed(items: DataFrame, path: str, checkpoint: str | None = None):
    """Starts a stream that adds shared items to the table ``path``, one folder for each batch; a batch that is run again replaces its own.

    Every item keeps its own time to live, so expiry is a filter of reads (``memory.live_context``) and the feed has no
    state and drops nothing. With a ``checkpoint`` folder of its own, a stream goes on where it ended.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint or f"{path}-state-{uuid.uuid4().hex}").trigger(availableNow=True).start()


def store_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
