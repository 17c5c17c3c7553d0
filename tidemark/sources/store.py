"""Keyed tables: upserts, point-in-time reads, and the build of a market store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = {"prices": ("symbol", "date"), "news": ("event_id",), "filings": ("filing_id",), "memories": ("memory_id",)}


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], sequence: str | None = None) -> DataFrame:
    """Rows of ``old`` and ``new``, the last write of each key. Within one side the largest ``sequence`` is the last,
    and of equal ones (or without a sequence) one by a hash of the whole row, so reruns agree.

    One shuffle by the keys; a key's versions are compared by max_by, so they aren't sorted or gathered.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    hashed = [c for c in rest if "map<" not in both.schema[c].dataType.simpleString()]  # maps have no hash
    order: list[Column] = [F.col("_new")] + ([F.col(sequence)] if sequence else []) + [F.xxhash64(*hashed)]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return both.groupBy(*keys).agg(last).select(*keys, "last.*").select(*[c for c in old.columns])


def with_metadata_json(df: DataFrame, column: str = "metadata") -> DataFrame:
    """A map or struct of metadata as JSON text."""
    return df.withColumn(f"{column}_json", F.coalesce(F.to_json(column), F.lit("{}"))).drop(column)


def fenced(df: DataFrame, as_of: Column | str, order: str) -> DataFrame:
    """Rows available at ``as_of``, oldest first."""
    moment = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return df.where(F.col("available_at") <= moment).orderBy("available_at", order)


def end_of_day(day: str) -> Column:
    """The last microsecond of a date: the fence of a step that names no time."""
    return F.expr(f"timestamp_ntz'{day} 23:59:59.999999'")


def for_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of the symbols in a table with a column ``symbol``; values are data, never SQL text."""
    return df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def trading_dates(bars: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    return (bars if symbols is None else for_symbols(bars, symbols)).select("date").distinct()


def metadata_search(df: DataFrame, limit: int, as_of: Column | None = None, **equal: str | None) -> DataFrame:
    """The newest records that match every given filter."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if as_of is not None:
        df = df.where(F.col("available_at") <= as_of)
    return df.orderBy(F.col("event_date").desc(), F.col("created_at").desc(), "memory_id").limit(limit)


def distinct_on(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def snapshot(df: DataFrame, path: str, as_of_date: str) -> None:
    """Saves a state as it was on a date; a rerun of the date replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/as_of_date={as_of_date}")


def restore(spark, path: str, as_of_date: str) -> DataFrame:
    return spark.read.parquet(f"{path}/as_of_date={as_of_date}")


def build_market_store(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes prices, news and filings, one row for each key and sorted for pruning, and returns the trading dates."""
    order = {"prices": ("symbol", "date"), "news": ("symbol", "available_at"), "filings": ("symbol", "available_at")}
    for name, df in tables.items():
        keys = KEYS[name]
        unique = upsert(df.limit(0), df, keys)
        ranges = unique.repartitionByRange(*order[name])  # a symbol with very many rows is as many ranges as it fills
        ranges.sortWithinPartitions(*order[name]).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    spark = tables["prices"].sparkSession
    return trading_dates(spark.read.parquet(f"{path}/prices.parquet")).orderBy("date")
