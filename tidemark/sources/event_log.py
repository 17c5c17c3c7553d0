"""An append-only log of typed artifacts as JSON files, partitioned by type and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id string, artifact_type string, date string, created_at string, payload string, metadata string"


def artifacts(df: DataFrame, artifact_type: str, date: str, *payload: str, id_from: str | None = None) -> DataFrame:
    """Log lines of a table: one artifact per row, its payload columns as JSON. Without ``id_from`` ids are random."""
    key = F.expr("uuid()") if id_from is None else F.sha2(F.concat_ws("|", F.lit(artifact_type), F.col(id_from).cast("string")), 256)
    return df.select(key.alias("event_id"), F.lit(artifact_type).alias("artifact_type"), F.col(date).cast("string").alias("date"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"), F.lit("{}").alias("metadata"))


def append(lines: DataFrame, path: str) -> None:
    """Adds lines; a partition's lines are gathered first, so a day isn't spread over many small files, and a large day is split by its size."""
    lines.hint("rebalance", "artifact_type", "date").write.mode("append").partitionBy("artifact_type", "date").json(path)


def read(spark: SparkSession, path: str, artifact_type: str | None = None, date: str | None = None) -> DataFrame:
    """Lines of a type and date; both prune partitions. Blank lines aren't lines."""
    df = spark.read.schema(SCHEMA).json(path)
    if artifact_type is not None:
        df = df.where(F.col("artifact_type") == artifact_type)
    if date is not None:
        df = df.where(F.col("date") == date)
    return df.where("event_id is not null")


def typed(lines: DataFrame, schema: str, **equal: str) -> DataFrame:
    """Payloads as columns, with equality filters."""
    out = lines.select("event_id", "artifact_type", F.from_json("payload", schema).alias("payload")).select("event_id", "artifact_type", "payload.*")
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out
