"""Streams over the event table, drained into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory
from ..sources import event_log
from ..streaming import feeds, ordered, sinks
from .registry import query
from .storage import _log
from .views import table


def events_of(spark, sf_dir):
    return feeds.stream_table(spark, f"{sf_dir}/events.parquet")


@query("SELECT 'price_bar' AS artifact_type, CAST(date AS STRING) AS date, count(*) AS n FROM bars GROUP BY 2", "bars")
def stream_event_log(spark, sf_dir):
    lines = feeds.tail_log(spark, _log(spark, sf_dir), event_log.SCHEMA, "price_bar")
    tailed = sinks.drain(lines.select("event_id", "artifact_type", "date"))
    return tailed.groupBy("artifact_type", "date").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS date FROM events")
def stream_news_dedup(spark, sf_dir):
    rows = events_of(spark, sf_dir).withColumn("key", F.concat_ws("|", "user_id", "event_type", F.to_date("ts").cast("string")))
    return sinks.drain(feeds.dedup_feed(rows, "key", "ts", "60 days").select("user_id", "event_type", F.to_date("ts").alias("date")))


@query("SELECT user_id, event_type, max_by(event_id, event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_replace(spark, sf_dir):
    path = feeds.store_path(spark)
    rows = events_of(spark, sf_dir).select("user_id", "event_type", "event_id")
    run = feeds.replacing_feed(rows, path, ("user_id", "event_type"), "event_id")
    run.awaitTermination()
    return feeds.feed_snapshot(spark, path, run.lastProgress["batchId"], rows.schema)


#: How far the rows of a replayed file may be behind the newest, and files of a micro-batch.
DELAY, FILES = "31 days", 16


def replayed_events(spark, sf_dir, *columns):
    """Columns of the event table, written in the order of their times, as a stream."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", *columns)
    path = ordered.stream_folder(spark)
    ordered.replay(rows, path, ordered.spans(rows, DELAY))
    return ordered.replayed(spark, path, rows.schema, FILES)


@query(
    """WITH s AS (SELECT concat('agent_', event_type) AS agent_id, concat('U', CAST(user_id AS STRING)) AS symbol, ts, event_id, (value - 50) / 1000 AS step FROM events),
v AS (SELECT *, 100 * product(1 + step) OVER w AS value, row_number() OVER w AS n, avg(step) OVER w AS mean, coalesce(stddev_samp(step) OVER w, 0) AS spread, avg(CASE WHEN step > 0 THEN 1e0 ELSE 0e0 END) OVER w AS win_rate
      FROM s WINDOW w AS (PARTITION BY agent_id, symbol ORDER BY ts, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, max(value) OVER (PARTITION BY agent_id, symbol ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS peak FROM v)
SELECT agent_id, symbol, n, round(value, 4) AS value, round(value / 100 - 1, 6) AS roi, round(value / 100 - 1, 6) AS rolling_return, round(CASE WHEN n < 2 OR spread <= 1e-12 THEN 0 ELSE mean / spread END, 6) AS sharpe,
       round(min(value / peak - 1) OVER (PARTITION BY agent_id, symbol ORDER BY ts, step ROWS UNBOUNDED PRECEDING), 6) AS drawdown, round(win_rate, 6) AS win_rate FROM p"""
)
def stream_shadow(spark, sf_dir):
    steps = replayed_events(spark, sf_dir, F.concat(F.lit("agent_"), "event_type").alias("agent_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), ((F.col("value") - 50) / 1000).alias("step"))
    rows = sinks.drain(ordered.running_shadow(steps, DELAY).where("agent_id is not null"))
    return rows.select("agent_id", "symbol", "n", F.round("value", 4).alias("value"), *(F.round(c, 6).alias(c) for c in ("roi", "rolling_return", "sharpe", "drawdown", "win_rate")))


@query(
    f"""WITH RECURSIVE r AS (SELECT CAST(event_id AS STRING) AS route_id, event_type AS source_agent_id, concat('agent_', CAST(user_id % 10 AS STRING)) AS target_agent_id, [event_id % 3, event_id % 5] AS ids, ts, epoch_us(ts) // 1000 AS ms FROM events),
kept AS (SELECT source_agent_id, target_agent_id, ids, min(ms) AS ms FROM r GROUP BY ALL
         UNION ALL SELECT k.source_agent_id, k.target_agent_id, k.ids, min(r.ms) AS ms FROM kept k JOIN r ON r.source_agent_id = k.source_agent_id AND r.target_agent_id = k.target_agent_id AND r.ids = k.ids AND r.ms >= k.ms + {3 * 86_400_000} GROUP BY 1, 2, 3)
SELECT route_id, source_agent_id, target_agent_id, NOT (k.ms IS NOT NULL AND row_number() OVER (PARTITION BY source_agent_id, target_agent_id, ids, ms ORDER BY ts, route_id) = 1) AS deduped FROM r LEFT JOIN kept k USING (source_agent_id, target_agent_id, ids, ms)"""
)
def stream_share_dedup(spark, sf_dir):
    ids = F.array(F.col("event_id") % 3, F.col("event_id") % 5).alias("memory_ids")
    routes = replayed_events(spark, sf_dir, F.col("event_id").cast("string").alias("route_id"), F.col("event_type").alias("source_agent_id"), F.concat(F.lit("agent_"), (F.col("user_id") % 10).cast("string")).alias("target_agent_id"), ids)
    return sinks.drain(ordered.first_shares(routes, "3 days", DELAY).where("source_agent_id is not null")).drop("ts")


@query(
    """WITH i AS (SELECT concat('U', CAST(user_id AS STRING)) AS owner, CAST(event_id AS STRING) AS item_id, ts, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 7 + 1 AS INTEGER) END AS until FROM events)
SELECT owner, item_id, 'added' AS event, epoch_us(ts) // 1000 AS at_ms FROM i UNION ALL SELECT owner, item_id, 'expired', epoch_us(until) // 1000 FROM i WHERE until IS NOT NULL"""
)
def stream_context_expiry(spark, sf_dir):
    """Items live through the day that is event_id % 7 days after their own; those of 0 for ever."""
    until = F.when(F.col("event_id") % 7 != 0, F.date_add(F.to_date("ts"), (F.col("event_id") % 7 + 1).cast("int")).cast("timestamp")).alias("until")
    items = replayed_events(spark, sf_dir, F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("owner"), F.col("event_id").cast("string").alias("item_id"), until)
    return sinks.drain(ordered.expiring_context(items, DELAY).where("owner is not null")).select("owner", "item_id", "event", F.unix_millis("at").alias("at_ms"))


@query("SELECT event_id, user_id, created_at, ttl_days FROM (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS created_at, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 7 AS INTEGER) END AS ttl_days FROM events) WHERE ttl_days IS NULL OR created_at IS NULL OR DATE '2024-01-28' <= created_at + ttl_days")
def stream_context_ttl(spark, sf_dir):
    path = feeds.store_path(spark)
    items = events_of(spark, sf_dir).selectExpr("event_id", "user_id", "case when event_id % 11 = 0 then null else cast(ts as date) end as created_at", "case when event_id % 7 = 0 then null else cast(event_id % 7 as int) end as ttl_days")
    feeds.context_feed(items, path).awaitTermination()
    return memory.live_context(spark.read.schema(items.schema).parquet(path), F.lit("2024-01-28").cast("date")).select("event_id", "user_id", "created_at", "ttl_days")
