"""Market tables from Parquet and CSV: header clean-up, required columns, defaults and stable ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint, source string"
NEWS = "event_id string, symbol string, published_at timestamp_ntz, available_at timestamp_ntz, title string, text string, source string, url string, metadata_json string"
FILINGS = "filing_id string, symbol string, filing_type string, filing_date date, accepted_at timestamp_ntz, available_at timestamp_ntz, text string, source string, url string, metadata_json string"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or no rows of ``schema`` where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def normal_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def require(df: DataFrame, *columns: str, any_of: tuple[str, ...] = ()) -> DataFrame:
    """Fails before any job if a column is missing, or all of ``any_of`` are."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if any_of and not set(any_of) & set(df.columns):
        raise ValueError(f"one of these columns is needed: {', '.join(any_of)}")
    return df


def optional(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def as_date(df: DataFrame, name: str) -> Column:
    """A date from a date, a timestamp or ISO text."""
    kind = df.schema[name].dataType
    return F.to_date(F.substring(F.trim(F.col(name)), 1, 10)) if isinstance(kind, T.StringType) else F.col(name).cast("date")


def prices(df: DataFrame) -> DataFrame:
    df = require(normal_headers(df), "symbol", "date", "close")
    columns = [F.col("symbol").cast("string").alias("symbol"), as_date(df, "date").alias("date")]
    columns += [optional(df, c, "double").alias(c) for c in ("open", "high", "low", "close", "adj_close")]
    return df.select(*columns, optional(df, "volume", "bigint").alias("volume"), F.coalesce(optional(df, "source", "string"), F.lit("parquet")).alias("source"))


def news(df: DataFrame) -> DataFrame:
    df = require(normal_headers(df), "symbol", "text", any_of=("published_at", "available_at"))
    published, available = optional(df, "published_at", "timestamp_ntz"), optional(df, "available_at", "timestamp_ntz")
    title, text = optional(df, "title", "string"), F.col("text").cast("string")
    given = stable_id(F.col("symbol"), iso(F.coalesce(published, available)), title, text)
    return df.select(
        F.coalesce(optional(df, "event_id", "string"), given).alias("event_id"), F.col("symbol").cast("string").alias("symbol"),
        F.coalesce(published, available).alias("published_at"), F.coalesce(available, published).alias("available_at"),
        title.alias("title"), text.alias("text"), F.coalesce(optional(df, "source", "string"), F.lit("parquet")).alias("source"),
        optional(df, "url", "string").alias("url"), optional(df, "metadata_json", "string").alias("metadata_json"),
    )


def filings(df: DataFrame) -> DataFrame:
    df = require(normal_headers(df), "symbol", "text", any_of=("filing_date", "available_at"))
    day, available = optional(df, "filing_date", "date"), optional(df, "available_at", "timestamp_ntz")
    kind, text = F.coalesce(optional(df, "filing_type", "string"), F.lit("10-Q")), F.col("text").cast("string")
    filed = F.coalesce(day, available.cast("date"))
    return df.select(
        F.coalesce(optional(df, "filing_id", "string"), stable_id(F.col("symbol"), kind, filed, text)).alias("filing_id"), F.col("symbol").cast("string").alias("symbol"), kind.alias("filing_type"),
        filed.alias("filing_date"), optional(df, "accepted_at", "timestamp_ntz").alias("accepted_at"), F.coalesce(available, filed.cast("timestamp_ntz")).alias("available_at"),
        text.alias("text"), F.coalesce(optional(df, "source", "string"), F.lit("parquet")).alias("source"), optional(df, "url", "string").alias("url"), optional(df, "metadata_json", "string").alias("metadata_json"),
    )


def market_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """prices, news and filings by their standard file names; a missing file is an empty table."""
    shapes = {"prices": (PRICES, prices), "news": (NEWS, news), "filings": (FILINGS, filings)}
    return {name: make(read_or_empty(spark, f"{folder}/{name}.parquet", schema)) for name, (schema, make) in shapes.items()}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


#: Folders of a table by key, however many keys there are.
BUCKETS = 256


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_csv_by_key(df: DataFrame, path: str, key: str) -> None:
    """A CSV table with each key's rows next to each other, in one file of the key's bucket, so files don't grow with keys."""
    dealt = df.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket")
    write_csv(dealt.sortWithinPartitions("bucket", key), path, ("bucket",))


def read_csv_by_key(spark: SparkSession, path: str, schema: str, key: str, value: str | None = None) -> DataFrame:
    """The table of ``write_csv_by_key``, or only one key's rows, for which the key's bucket is read."""
    rows = read_csv(spark, path, f"{schema}, bucket int")
    if value is not None:
        rows = rows.where((F.col("bucket") == bucket_of(F.lit(value))) & (F.col(key) == value))
    return rows.drop("bucket")


def write_feed(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
