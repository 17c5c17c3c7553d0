"""Upserts into a stored table that rewrite only the partitions they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import upsert
from .written import complete, exists, written

#: The column a stored table is partitioned by.
PART = "part"


def hashed(keys: tuple[str, ...], parts: int = 64) -> Column:
    """A partition by a hash of the keys, for keys that name no range of their own."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")


def merge_into(path: str, new: DataFrame, keys: tuple[str, ...], batch: str, part: Column | None = None, sequence: str | None = None) -> None:
    """Upserts ``new`` into the table at ``path``: of each key the last write counts (see ``store.upsert``).

    ``part`` is a function of the keys (a hash of them unless given; nulls have a partition too) that must be the same for
    each merge of a table. Merged rows of the touched partitions are staged under the name of the batch, then
    replace those partitions, and no others are read or written. A batch that was cut off is called again and goes on
    from what it had staged, so a partition that is half replaced is never read; one that ended changes nothing.
    The staged rows stay until the caller drops ``{path}-staged``. An empty batch writes nothing.
    """
    spark, stage = new.sparkSession, f"{path}-staged/{batch}"
    if complete(spark, f"{stage}-done"):
        return
    if not complete(spark, stage):
        rows = new.withColumn(PART, F.coalesce((hashed(keys) if part is None else part).cast("string"), F.lit("none")))
        if exists(spark, path):
            touched = rows.select(PART).distinct()
            old = spark.read.schema(rows.schema).parquet(path).join(touched, PART, "left_semi")  # pruned by the values of ``touched``
            rows = upsert(old.select(*rows.columns), rows, keys, sequence)
        else:
            rows = upsert(rows.limit(0), rows, keys, sequence)
        written(rows, stage)
    merged = spark.read.schema(new.schema.add(PART, "string")).parquet(stage)
    # a partition is one or more files of about the advised size, each sorted by key
    merged.hint("rebalance", PART).sortWithinPartitions(PART, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    spark.range(0).write.mode("overwrite").parquet(f"{stage}-done")


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a stored table."""
    return spark.read.schema(schema).parquet(path)
