"""News and filings: selection, cleaning, deduplication and day tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof, news
from ..sources import tables
from .registry import query
from .views import table, view

CLEAN = rf"translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\r\n]+', ' ', 'g'), '{T.URL}', '<url>', 'g'), '{T.EMAIL}', '<email>', 'g'), '{T.PHONE}', '<phone>', 'g'), '{T.ACCENTED}', '{T.FOLDED}')"
#: The demonstration lexicon: frequent words with a polarity.
LEXICON = [("and", 1), ("with", 1), ("for", 1), ("not", -1), ("by", -1), ("mit", 1), ("les", -1)]


@query(
    r"""WITH j AS (SELECT event_id, symbol, published_at, regexp_replace(headline, '^[0-9]+', '') AS norm FROM news WHERE published_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-03 18:00:00' AND lang = 'en' AND length(text) > 300 AND (symbol LIKE 'U1%' OR symbol = 'U2'))
SELECT norm, max_by(event_id, (published_at, -CAST(substring(event_id, 2) AS BIGINT))) AS event_id, max(published_at) AS published_at FROM j GROUP BY norm""",
    "news",
)
def news_select(spark, sf_dir):
    items = view(spark, sf_dir, "news")
    found = news.select_news(items.drop("symbol"), items.select("event_id", "symbol"), "2024-01-01 06:00:00", "2024-01-03 18:00:00", "U1", "U2")
    return found.select("norm", "event_id", "published_at")


@query(
    """WITH r AS (SELECT *, regexp_replace(headline, 'UPDATE [0-9]+-', '') AS norm, CAST(regexp_extract(headline, 'UPDATE ([0-9]+)-', 1) AS BIGINT) AS update_no FROM news)
SELECT symbol, event_id, update_no FROM (SELECT *, row_number() OVER (PARTITION BY symbol, norm ORDER BY update_no DESC, published_at DESC, event_id) AS k FROM r) WHERE k = 1""",
    "news",
)
def news_latest_update(spark, sf_dir):
    return news.latest_update(view(spark, sf_dir, "news")).select("symbol", "event_id", "update_no")


@query(
    f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, replace(text, ' ', '') ORDER BY published_at DESC, event_id) AS k FROM news) WHERE k = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, replace(headline, ' ', '') ORDER BY published_at DESC, event_id) AS k2 FROM a) WHERE k2 = 1),
c AS (SELECT *, {CLEAN} AS clean FROM b)
SELECT event_id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol, clean ORDER BY published_at, event_id) AS k3 FROM c) WHERE k3 = 1""",
    "news",
)
def news_exact_dedup(spark, sf_dir):
    items = view(spark, sf_dir, "news")
    return news.exact_dedup(items).select("event_id", "symbol")


@query()
def news_near_dup(spark, sf_dir):
    items = view(spark, sf_dir, "news")
    kept = news.drop_near_duplicates(items)
    return kept.select("event_id", "symbol", "published_at")


@query()
def news_near_dup_levenshtein(spark, sf_dir):
    """Every headline (no SQL: DuckDB's edits are of bytes; compared with plain Python)."""
    return _near_dup_levenshtein(view(spark, sf_dir, "news"))


@query()
def news_near_dup_levenshtein_all(spark, sf_dir):
    return news_near_dup_levenshtein(spark, sf_dir)


def _near_dup_levenshtein(items):
    kept = news.drop_near_previous(items, "headline", 0.3, ("lang",), news.levenshtein_similarity("headline"))
    return kept.select("event_id", "symbol")


@query("SELECT CAST(published_at AS DATE) AS date, symbol, string_agg(event_id, ',' ORDER BY published_at, event_id) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM news GROUP BY 1, 2", "news")
def news_by_day(spark, sf_dir):
    days = news.by_day(view(spark, sf_dir, "news"), F.col("published_at").cast("date"))
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return days.select("date", "symbol", F.array_join("ids", ",").alias("ids"), chars.alias("chars"))


@query(
    """WITH c AS (SELECT DISTINCT date FROM bars WHERE dayofweek(date) BETWEEN 1 AND 5), d AS (SELECT event_id, CASE WHEN hour(published_at) >= 16 THEN CAST(published_at AS DATE) + 1 ELSE CAST(published_at AS DATE) END AS date FROM news)
SELECT event_id, date, (SELECT min(c.date) FROM c WHERE c.date >= d.date) AS trading_date FROM d""",
    "bars news",
)
def align_trading_day(spark, sf_dir):
    calendar = view(spark, sf_dir, "bars").select("date").distinct().where("weekday(date) < 5")
    rows = view(spark, sf_dir, "news").select("event_id", asof.session_date(F.col("published_at")).alias("date"))
    return rows.join(asof.next_trading_day(rows.select("date").distinct(), calendar), "date", "left").select("event_id", "date", "trading_date")


@query("SELECT event_id, CASE WHEN hour(published_at) >= 16 THEN CAST(published_at AS DATE) + 1 ELSE CAST(published_at AS DATE) END AS session_date FROM news", "news")
def news_session_date(spark, sf_dir):
    return view(spark, sf_dir, "news").select("event_id", asof.session_date(F.col("published_at")).alias("session_date"))


@query("SELECT event_id, CAST(CASE WHEN hour(published_at) >= 16 AND (minute(published_at) > 0 OR second(published_at) > 0) THEN CAST(published_at AS DATE) + 1 ELSE CAST(published_at AS DATE) END AS TIMESTAMP) + INTERVAL 9 HOUR AS stamp FROM news", "news")
def news_session_stamp(spark, sf_dir):
    return view(spark, sf_dir, "news").select("event_id", asof.session_stamp(F.col("published_at")).alias("stamp"))


@query("SELECT event_id, sha256(concat_ws('|', symbol, strftime(published_at, '%Y-%m-%dT%H:%M:%S'), '', text)) AS id FROM news", "news")
def stable_id(spark, sf_dir):
    rows = view(spark, sf_dir, "news")
    return rows.select("event_id", tables.stable_id(F.col("symbol"), tables.iso(F.col("published_at")), F.lit(None).cast("string"), F.col("text")).alias("id"))


@query("SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS eastern FROM events")
def utc_to_eastern(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("eastern"))


@query("WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(lang, ' (Reuters) ', text) ELSE text END AS body FROM documents) SELECT doc_id, sha256(CASE WHEN strpos(body, '(Reuters)') > 0 THEN substring(body, strpos(body, '(Reuters)')) ELSE body END) AS body_sha256 FROM b")
def trim_dateline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(" (Reuters) "), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", body.alias("body")).select("doc_id", F.sha2(T.trim_dateline(F.col("body")), 256).alias("body_sha256"))


@query(f"SELECT doc_id, sha256({CLEAN}) AS clean_sha256 FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("clean_sha256"))


@query("SELECT doc_id, substring(text, 1, 200) AS summary FROM documents")
def summary_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.summary_prefix(F.col("text")).alias("summary"))


EMBEDDING3 = "SELECT doc_id, round(length(text) / 1000e0, 6) AS x, round((coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))), 0) % 997) / 997e0, 6) AS y, round((length(text) - length(replace(text, chr(10), ''))) / 100e0, 6) AS z FROM documents"


@query(EMBEDDING3)
def text_embedding3(spark, sf_dir):
    return _text_embedding3(table(spark, sf_dir, "documents"))


@query(EMBEDDING3)
def text_embedding3_all(spark, sf_dir):
    return text_embedding3(spark, sf_dir)


def _text_embedding3(rows):
    docs = rows.select("doc_id", T.text_embedding3(F.col("text")).alias("v"))
    return docs.select("doc_id", *(F.round(F.col("v")[k], 6).alias(c) for k, c in enumerate("xyz")))


@query("WITH l AS (SELECT DISTINCT concat('s', CAST(l_suppkey * 2 AS STRING)) AS ticker FROM lineitem) SELECT ticker, CASE WHEN s_suppkey IS NOT NULL THEN lpad(CAST(s_suppkey AS STRING), 10, '0') END AS company_id, s_name AS title FROM l LEFT JOIN supplier ON concat('S', CAST(s_suppkey AS STRING)) = upper(ticker)")
def company_id_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") * 2).cast("string")).alias("ticker")).distinct()
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("key"), T.padded_id(F.col("s_suppkey")).alias("company_id"), F.col("s_name").alias("title"))
    return asked.join(known, F.upper("ticker") == F.col("key"), "left").select("ticker", "company_id", "title")


@query("SELECT url, sha256(text) AS text_sha256, symbol, filing_type, CAST((available_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS eastern FROM filings WHERE length(text) % 7 <> 0", "filings")
def filing_extract(spark, sf_dir):
    rows = view(spark, sf_dir, "filings")
    contents = rows.select("url", F.when(F.length("text") % 7 != 0, F.col("text")).alias("text"), "filing_id")
    index = rows.select("url", "symbol", "filing_type", F.col("available_at").cast("timestamp").alias("available_at"), F.col("filing_id").alias("id"))
    found = news.filing_extract(contents, index.where("filing_type = '10-K'"), index.where("filing_type = '10-Q'")).where("id = filing_id")
    return found.select("url", F.sha2("text", 256).alias("text_sha256"), "symbol", "filing_type", F.col("eastern").cast("timestamp_ntz").alias("eastern"))


ENV = """n AS (SELECT CAST(published_at AS DATE) AS date, symbol, string_agg(event_id, ',' ORDER BY published_at, event_id) AS ids FROM news GROUP BY 1, 2),
f AS (SELECT filing_date AS date, symbol, max_by(filing_id, (available_at, filing_id)) FILTER (filing_type = '10-K') AS filing_k, max_by(filing_id, (available_at, filing_id)) FILTER (filing_type = '10-Q') AS filing_q FROM filings GROUP BY 1, 2),
env AS (SELECT date, symbol, round(close, 6) AS close, coalesce(ids, '') AS ids, filing_k, filing_q FROM bars LEFT JOIN n USING (date, symbol) LEFT JOIN f USING (date, symbol))"""


def env_of(spark, sf_dir):
    return news.env_panel(view(spark, sf_dir, "bars"), view(spark, sf_dir, "news"), view(spark, sf_dir, "filings"))


@query(f"WITH {ENV} SELECT * FROM env", "bars news filings")
def env_panel(spark, sf_dir):
    return env_of(spark, sf_dir).select("date", "symbol", F.round("close", 6).alias("close"), F.array_join("ids", ",").alias("ids"), "filing_k", "filing_q")


@query(f"WITH {ENV} SELECT date, close, ids, filing_k, filing_q FROM env WHERE symbol = 'U7' AND ids <> ''", "bars news filings")
def env_symbol_subset(spark, sf_dir):
    found = news.symbol_subset(news.as_maps(env_of(spark, sf_dir).where(F.col("symbol") == "U7")), "U7")  # the filter reaches the scans
    return found.select("date", F.round("close", 6).alias("close"), F.array_join("ids", ",").alias("ids"), "filing_k", "filing_q")


@query(
    f"""WITH lex(word, polarity) AS (VALUES {", ".join(map(str, LEXICON))}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
s AS (SELECT doc_id, count(*)::DOUBLE AS n, count(*) FILTER (polarity > 0) AS p, count(*) FILTER (polarity < 0) AS m FROM t LEFT JOIN lex USING (word) GROUP BY doc_id)
SELECT doc_id, round(p / n, 6) AS positive, round(m / n, 6) AS negative, round((n - p - m) / n, 6) AS neutral FROM s"""
)
def news_sentiment(spark, sf_dir):
    lexicon = F.broadcast(spark.createDataFrame(LEXICON, "word string, polarity int"))  # a fixed, small list
    found = news.sentiment(table(spark, sf_dir, "documents"), lexicon, "doc_id")
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("positive", "negative", "neutral")))


@query()
def news_clean_pipeline(spark, sf_dir):
    found = news.clean_job(view(spark, sf_dir, "news"), view(spark, sf_dir, "bars").select("date").distinct())
    return found.select("event_id", "symbol", "date", "trading_date", F.sha2("text", 256).alias("text_sha256"))
