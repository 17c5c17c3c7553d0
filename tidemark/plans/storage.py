"""Loading, upserting, logging and building tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import event_log, merge, store, tables
from ..streaming.sinks import shared_folder
from .registry import query
from .views import table, view


@query("SELECT symbol, date, round(close, 6) AS close, volume, 'parquet' AS source FROM bars", "bars")
def load_prices(spark, sf_dir):
    raw = view(spark, sf_dir, "bars").select(F.col("symbol").alias(" Symbol"), F.col("date").cast("string").alias("DATE"), F.col("close").alias("Close "), F.col("volume").alias("volume"))
    return tables.prices(raw).select("symbol", "date", F.round("close", 6).alias("close"), "volume", "source")


@query("SELECT sha256(concat_ws('|', symbol, strftime(available_at, '%Y-%m-%dT%H:%M:%S'), headline, text)) AS event_id, symbol, available_at AS published_at, available_at FROM news", "news")
def load_news(spark, sf_dir):
    raw = view(spark, sf_dir, "news").select("symbol", "available_at", F.col("headline").alias("title"), "text")
    return tables.news(raw).select("event_id", "symbol", "published_at", "available_at")


@query("SELECT sha256(concat_ws('|', symbol, '10-Q', CAST(filing_date AS STRING), text)) AS filing_id, symbol, '10-Q' AS filing_type, filing_date, CAST(filing_date AS TIMESTAMP) AS available_at FROM filings", "filings")
def load_filings(spark, sf_dir):
    raw = view(spark, sf_dir, "filings").select("symbol", "filing_date", "text")
    return tables.filings(raw).select("filing_id", "symbol", "filing_type", "filing_date", "available_at")


@query("SELECT symbol, date, round(CASE WHEN date >= DATE '2024-01-20' THEN close * 2 ELSE close END, 6) AS close FROM bars UNION ALL SELECT concat(symbol, 'x'), date, round(close, 6) FROM bars WHERE date >= DATE '2024-01-28'", "bars")
def upsert_prices(spark, sf_dir):
    bars = view(spark, sf_dir, "bars").select("symbol", "date", "close").withColumn("seq", F.lit(0))
    late = bars.where("date >= date'2024-01-20'")
    new = late.withColumn("close", F.col("close") * 3).unionByName(late.withColumns({"close": F.col("close") * 2, "seq": F.lit(1)}))
    new = new.unionByName(bars.where("date >= date'2024-01-28'").withColumn("symbol", F.concat("symbol", F.lit("x"))))
    return store.upsert(bars, new, store.KEYS["prices"], "seq").select("symbol", "date", F.round("close", 6).alias("close"))


@query(
    """SELECT symbol, date, round(CASE WHEN date >= DATE '2024-01-27' AND symbol LIKE '%3' THEN close * 4 WHEN date >= DATE '2024-01-26' THEN close * 2 ELSE close END, 6) AS close FROM bars
UNION ALL SELECT concat(symbol, 'x'), date, round(close, 6) FROM bars WHERE date >= DATE '2024-01-27' AND symbol LIKE '%3'""",
    "bars",
)
def merge_prices(spark, sf_dir):
    """A store partitioned by day after its first load and two merges, the second called twice."""
    bars, path = view(spark, sf_dir, "bars").select("symbol", "date", "close"), f"{shared_folder(spark)}/prices-{uuid.uuid4().hex}"
    first = bars.where("date >= date'2024-01-26'").withColumn("close", F.col("close") * 2)
    late = bars.where("date >= date'2024-01-27' and symbol like '%3'")
    second = late.withColumn("close", F.col("close") * 4).unionByName(late.withColumn("symbol", F.concat("symbol", F.lit("x"))))
    for name, rows in (("load", bars), ("a", first), ("b", second), ("b", second)):
        merge.merge_into(path, rows, store.KEYS["prices"], name, F.date_format("date", "yyyy-MM-dd"))
    return merge.stored(spark, path, bars.schema).select("symbol", "date", F.round("close", 6).alias("close"))


@query("""SELECT event_id, symbol, CASE WHEN CAST(substring(event_id, 2) AS BIGINT) % 2 = 0 THEN concat('{"lang":"', lang, '","source":"', source, '"}') ELSE '{}' END AS metadata_json FROM news""", "news")
def upsert_news(spark, sf_dir):
    rows = view(spark, sf_dir, "news").select("event_id", "symbol", "lang", "source")
    old = store.with_metadata_json(rows.select("event_id", "symbol", F.lit(None).cast("struct<lang:string,source:string>").alias("metadata")))
    new = store.with_metadata_json(rows.where("cast(substring(event_id, 2) as bigint) % 2 = 0").select("event_id", "symbol", F.struct("lang", "source").alias("metadata")))
    return store.upsert(old, new, store.KEYS["news"])


@query("SELECT filing_id, symbol, CASE WHEN filing_type = '10-K' THEN '10-K/A' ELSE filing_type END AS filing_type FROM filings", "filings")
def upsert_filings(spark, sf_dir):
    rows = view(spark, sf_dir, "filings").select("filing_id", "symbol", "filing_type")
    return store.upsert(rows, rows.where("filing_type = '10-K'").withColumn("filing_type", F.lit("10-K/A")), store.KEYS["filings"])


@query("""SELECT concat('M', CAST(id AS STRING)) AS memory_id, symbol, CASE WHEN id % 3 = 0 THEN 'long' ELSE layer END AS layer, CASE WHEN id % 3 = 0 THEN concat('{"importance":', CAST(CAST(importance AS BIGINT) AS STRING), '}') ELSE '{}' END AS metadata_json FROM memories""", "memories")
def upsert_memories(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").withColumn("memory_id", F.concat(F.lit("M"), F.col("id").cast("string")))
    kind = "struct<importance:bigint>"
    old = store.with_metadata_json(rows.select("memory_id", "symbol", "layer", F.lit(None).cast(kind).alias("metadata")))
    new = store.with_metadata_json(rows.where("id % 3 = 0").select("memory_id", "symbol", F.lit("long").alias("layer"), F.struct(F.col("importance").cast("long").alias("importance")).alias("metadata")))
    return store.upsert(old, new, store.KEYS["memories"])


@query("SELECT 'prices' AS name, symbol, count(*) AS n FROM bars GROUP BY symbol UNION ALL SELECT 'news', symbol, count(*) FROM news GROUP BY symbol UNION ALL SELECT 'filings', symbol, count(*) FROM filings GROUP BY symbol", "bars news filings")
def market_folder(spark, sf_dir):
    """The three tables by their standard file names, written and loaded again."""
    folder = f"{shared_folder(spark)}/market-{uuid.uuid4().hex}"
    for file, name in (("prices", "bars"), ("news", "news"), ("filings", "filings")):
        view(spark, sf_dir, name).write.parquet(f"{folder}/{file}.parquet")
    counts = [df.groupBy(F.lit(name).alias("name"), "symbol").agg(F.count("*").alias("n")) for name, df in tables.market_tables(spark, folder).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT symbol, date, agent_id, decision AS action FROM decisions", "decisions")
def export_actions(spark, sf_dir):
    """Each symbol's action table as CSV, read again."""
    path = f"{shared_folder(spark)}/actions-{uuid.uuid4().hex}"
    tables.write_csv_by_key(view(spark, sf_dir, "decisions").select("symbol", "date", "agent_id", F.col("decision").alias("action")), path, "symbol")
    return tables.read_csv_by_key(spark, path, "symbol string, date date, agent_id string, action string", "symbol")


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def distinct_on(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return store.distinct_on(rows, ("user_id", "event_type"), F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id")


def _log(spark, sf_dir) -> str:
    """Writes decisions and bars as artifacts and returns the log's path."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    decisions = view(spark, sf_dir, "decisions").withColumn("key", F.concat_ws("|", "agent_id", "symbol", "date"))
    event_log.append(event_log.artifacts(decisions, "agent_output", "date", "agent_id", "symbol", "decision", id_from="key"), path)
    bars = view(spark, sf_dir, "bars").withColumn("key", F.concat_ws("|", "symbol", "date"))
    event_log.append(event_log.artifacts(bars, "price_bar", "date", "symbol", "close", "volume", id_from="key"), path)
    return path


@query("SELECT 'agent_output' AS artifact_type, CAST(date AS STRING) AS date, count(*) AS n, count(*) AS ids FROM decisions GROUP BY 2 UNION ALL SELECT 'price_bar', CAST(date AS STRING), count(*), count(*) FROM bars GROUP BY 2", "decisions bars")
def event_log_write(spark, sf_dir):
    return event_log.read(spark, _log(spark, sf_dir)).groupBy("artifact_type", "date").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT 'agent_output' AS artifact_type, CAST(date AS STRING) AS date, concat('{\"agent_id\":\"', agent_id, '\",\"symbol\":\"', symbol, '\",\"decision\":\"', decision, '\"}') AS payload FROM decisions WHERE date = DATE '2024-01-03'", "decisions")
def event_log_scan(spark, sf_dir):
    return event_log.read(spark, _log(spark, sf_dir), "agent_output", "2024-01-03").select("artifact_type", "date", "payload")


@query("SELECT agent_id, symbol, decision FROM decisions WHERE agent_id = 'agent_click' AND symbol = 'U7'", "decisions")
def artifact_read(spark, sf_dir):
    lines = event_log.read(spark, _log(spark, sf_dir), "agent_output")
    return event_log.typed(lines, "agent_id string, symbol string, decision string", agent_id="agent_click", symbol="U7").select("agent_id", "symbol", "decision")


@query("SELECT DISTINCT date FROM bars", "bars")
def build_market_store(spark, sf_dir):
    news = tables.news(view(spark, sf_dir, "news").drop("lang", "headline"))
    frames = {"prices": tables.prices(view(spark, sf_dir, "bars")), "news": news, "filings": tables.filings(view(spark, sf_dir, "filings"))}
    return store.build_market_store(frames, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
