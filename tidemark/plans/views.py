"""Market tables derived from the driver's tables: bars, decisions, brand bars, news, filings and memories.

VIEWS has their SQL, in the syntax that Spark and DuckDB share; ``view`` runs it on the Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "bars": """SELECT concat('U', CAST(user_id AS STRING)) AS symbol, CAST(ts AS DATE) AS date,
       min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, max_by(value, ts) AS adj_close,
       CAST(count(*) AS BIGINT) AS volume, 'events' AS source FROM events GROUP BY 1, 2""",
    "decisions": """SELECT concat('agent_', event_type) AS agent_id, concat('U', CAST(user_id AS STRING)) AS symbol, CAST(ts AS DATE) AS date,
       CASE max_by(event_id, ts) % 3 WHEN 0 THEN 'sell' WHEN 1 THEN 'hold' ELSE 'buy' END AS decision FROM events GROUP BY 1, 2, 3""",
    "brand_bars": """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (100e0 * sum(CAST(l_quantity AS BIGINT))) AS close,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "news": """SELECT concat('N', CAST(d.doc_id AS STRING)) AS event_id, concat('U', CAST(e.user_id AS STRING)) AS symbol,
       e.ts AS published_at, e.ts + (d.doc_id % 48) * INTERVAL '1' HOUR AS available_at,
       concat('UPDATE ', CAST(d.doc_id % 4 AS STRING), '-', substring(d.text, 1, 20)) AS headline,
       d.text AS text, d.lang AS lang, d.source AS source FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "filings": """SELECT concat('F', CAST(p.page_id AS STRING)) AS filing_id, concat('U', CAST(e.user_id AS STRING)) AS symbol,
       CASE p.page_id % 2 WHEN 0 THEN '10-K' ELSE '10-Q' END AS filing_type,
       CAST(e.ts AS DATE) AS filing_date, e.ts + INTERVAL '16' HOUR AS available_at, p.html AS text, p.url AS url
       FROM pages p JOIN events e ON e.event_id = p.page_id""",
    "memories": """SELECT vec_id AS id, concat('L', CAST(label AS STRING)) AS symbol,
       CASE vec_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' WHEN 2 THEN 'long' ELSE 'reflection' END AS layer,
       CAST((vec_id * 37) % 101 AS DOUBLE) AS importance, CAST(vec_id % 10 AS BIGINT) AS delta,
       CAST(0 AS BIGINT) AS access_counter, embedding FROM embeddings""",
}
#: Base tables of each view.
BASES = {"bars": "events", "decisions": "events", "brand_bars": "lineitem part", "news": "documents events", "filings": "pages events", "memories": "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {base: table(spark, sf_dir, base) for base in BASES[name].split()}
    sql = VIEWS[name]
    for base in frames:
        for word in ("FROM ", "JOIN "):
            sql = sql.replace(word + base, word + "{" + base + "}")
    return spark.sql(sql, **frames)
