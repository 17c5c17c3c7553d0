"""Point-in-time panels, returns and shadow portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import decision_signal
from ..operators import asof, returns, segments, shadow
from ..sources import store
from .registry import query
from .views import table, view

#: SQL of the filled panel, of the decisions' signals and of the features on them.
PANEL = """grid AS (SELECT l.symbol, d.date FROM (SELECT symbol, min(date) AS first FROM bars GROUP BY symbol) l JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= l.first),
panel AS (SELECT g.symbol, g.date, last_value(b.close IGNORE NULLS) OVER w AS close, last_value(b.date IGNORE NULLS) OVER w AS bar_date
          FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.date = b.date
          WINDOW w AS (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SIGNALS = "signals AS (SELECT agent_id, symbol, date, CASE decision WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS signal FROM decisions)"
RETURNS = """rets AS (SELECT symbol, date, close, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS next_close FROM panel),
stepped AS (SELECT symbol, date, close, next_close, CASE WHEN close > 0 THEN next_close / close - 1 END AS ret FROM rets)"""
SHADOW = """steps AS (SELECT s.agent_id, s.symbol, s.date, s.signal, s.signal * coalesce(r.ret, 0) AS step FROM signals s LEFT JOIN stepped r USING (symbol, date)),
valued AS (SELECT *, 100 * product(1 + step) OVER w AS value, count(*) OVER w AS n, stddev_samp(step) OVER w AS spread, avg(step) OVER w AS mean, avg(CASE WHEN step > 0 THEN 1e0 ELSE 0e0 END) OVER w AS win_rate
           FROM steps WINDOW w AS (PARTITION BY agent_id, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
peaked AS (SELECT *, max(value) OVER (PARTITION BY agent_id, symbol ORDER BY date) AS peak FROM valued),
fallen AS (SELECT *, min(CASE WHEN peak > 0 THEN value / peak - 1 ELSE 0 END) OVER (PARTITION BY agent_id, symbol ORDER BY date) AS drawdown FROM peaked),
shadow AS (SELECT agent_id, symbol, date, signal, value, value / 100 - 1 AS roi, CASE WHEN n < 2 OR spread <= 1e-12 THEN 0 ELSE mean / spread END AS sharpe, drawdown, win_rate FROM fallen)"""


def panel_of(spark, sf_dir):
    return asof.price_panel(view(spark, sf_dir, "bars"))


def signals_of(spark, sf_dir):
    return view(spark, sf_dir, "decisions").withColumn("signal", decision_signal(F.col("decision")))


def shadows_of(spark, sf_dir, segment=None):
    panel = panel_of(spark, sf_dir)
    ahead = F.lead("close").over(returns.by_date("symbol"))
    rets = panel.select("symbol", "date", returns.simple_return(F.col("close"), ahead).alias("ret"))
    return shadow.shadow_portfolio(signals_of(spark, sf_dir).join(rets, ["symbol", "date"], "left"), segment=segment)


@query("SELECT symbol, max(date) AS date, round(max_by(close, date), 6) AS close, max_by(volume, date) AS volume FROM bars WHERE date <= DATE '2024-01-20' GROUP BY symbol", "bars")
def latest_bar(spark, sf_dir):
    found = asof.latest_bar(view(spark, sf_dir, "bars"), "2024-01-20")
    return found.select("symbol", "date", F.round("close", 6).alias("close"), "volume")


@query(f"WITH {PANEL} SELECT symbol, date, round(close, 6) AS close, bar_date FROM panel", "bars")
def price_panel(spark, sf_dir):
    return panel_of(spark, sf_dir).select("symbol", "date", F.round("close", 6).alias("close"), "bar_date")


@query("SELECT DISTINCT date FROM bars WHERE symbol IN ('U1', 'U2', 'U3')", "bars")
def list_dates(spark, sf_dir):
    symbols = view(spark, sf_dir, "bars").select("symbol").where(F.col("symbol").isin("U1", "U2", "U3"))
    return store.trading_dates(view(spark, sf_dir, "bars"), symbols)


@query("SELECT symbol, date, round(close, 6) AS close FROM bars WHERE symbol IN (SELECT concat('U', CAST(c_custkey AS STRING)) FROM customer WHERE c_custkey % 2 = 1)", "bars")
def symbol_filter(spark, sf_dir):
    symbols = table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("symbol"))
    return store.for_symbols(view(spark, sf_dir, "bars"), symbols).select("symbol", "date", F.round("close", 6).alias("close"))


@query("SELECT event_id, symbol, available_at FROM news WHERE available_at <= TIMESTAMP '2024-01-02 12:00:00'", "news")
def as_of_news(spark, sf_dir):
    return store.fenced(view(spark, sf_dir, "news"), "2024-01-02 12:00:00", "event_id").select("event_id", "symbol", "available_at")


@query("SELECT filing_id, symbol, available_at FROM filings WHERE available_at <= TIMESTAMP '2024-01-01 23:59:59.999999'", "filings")
def as_of_filings(spark, sf_dir):
    return store.fenced(view(spark, sf_dir, "filings"), store.end_of_day("2024-01-01"), "filing_id").select("filing_id", "symbol", "available_at")


@query("SELECT symbol, date, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'", "bars")
def date_range_closed(spark, sf_dir):
    return view(spark, sf_dir, "bars").where("date between date'2024-01-05' and date'2024-01-12'").select("symbol", "date", F.round("close", 6).alias("close"))


@query("SELECT symbol, date, round(close, 6) AS close FROM bars WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-12'", "bars")
def date_range_half_open(spark, sf_dir):
    return view(spark, sf_dir, "bars").where("date >= date'2024-01-05' and date < date'2024-01-12'").select("symbol", "date", F.round("close", 6).alias("close"))


COUNTS = """SELECT p.symbol, p.date, round(p.close, 6) AS close, p.bar_date,
       (SELECT count(*) FROM news n WHERE n.symbol = p.symbol AND CAST(n.available_at AS DATE) <= p.date) AS news_count,
       (SELECT count(*) FROM filings f WHERE f.symbol = p.symbol AND CAST(f.available_at AS DATE) <= p.date) AS filing_count FROM panel p"""


@query(f"WITH {PANEL} {COUNTS}", "bars news filings")
def market_step(spark, sf_dir):
    rows = asof.counts_so_far(panel_of(spark, sf_dir), view(spark, sf_dir, "news"), "news_count")
    rows = asof.counts_so_far(rows, view(spark, sf_dir, "filings"), "filing_count")
    return rows.select("symbol", "date", F.round("close", 6).alias("close"), "bar_date", "news_count", "filing_count")


@query(f"WITH {PANEL} SELECT p.symbol, p.date, n.event_id FROM panel p JOIN news n ON n.symbol = p.symbol AND CAST(n.available_at AS DATE) <= p.date", "bars news")
def market_step_texts(spark, sf_dir):
    return asof.texts_so_far(panel_of(spark, sf_dir), view(spark, sf_dir, "news"), "event_id").select("symbol", "date", "event_id")


@query(
    f"""WITH {PANEL}, {SIGNALS}, {RETURNS},
own AS (SELECT symbol, date, max_by(signal, agent_id) AS signal FROM signals GROUP BY symbol, date)
SELECT s.symbol, s.date, round(s.close, 6) AS close, round(s.ret, 6) AS ret, CASE WHEN s.ret > 0.01 THEN 1 WHEN s.ret < -0.01 THEN -1 WHEN s.ret IS NOT NULL THEN 0 END AS label,
       s.next_close IS NOT NULL AS has_next_price, coalesce(o.signal, 0) AS action_signal FROM stepped s LEFT JOIN own o USING (symbol, date)""",
    "bars decisions",
)
def quant_features(spark, sf_dir):
    signals = signals_of(spark, sf_dir).select("symbol", "date", F.col("signal").alias("action_signal"), F.col("agent_id").alias("seq"))
    rows = returns.quant_features(panel_of(spark, sf_dir), signals, 0.01)
    return rows.select("symbol", "date", F.round("close", 6).alias("close"), F.round("ret", 6).alias("ret"), "label", "has_next_price", "action_signal")


@query(f"WITH {PANEL}, {RETURNS} SELECT symbol, date, CASE WHEN close > 0 AND next_close > 0 THEN round(ln(next_close / close), 6) END AS log_return FROM stepped", "bars")
def log_returns(spark, sf_dir):
    ahead = F.lead("close").over(returns.by_date("symbol"))
    return panel_of(spark, sf_dir).select("symbol", "date", F.round(returns.log_return(F.col("close"), ahead), 6).alias("log_return"))


@query(f"WITH {PANEL}, {RETURNS} SELECT symbol, date, round(next_close - close, 6) AS record FROM stepped WHERE next_close IS NOT NULL", "bars")
def next_day_record(spark, sf_dir):
    return returns.next_day_record(panel_of(spark, sf_dir)).select("symbol", "date", F.round("record", 6).alias("record"))


ROUNDED = "agent_id, symbol, date, signal, round(value, 6) AS value, round(roi, 6) AS roi, round(sharpe, 6) AS sharpe, round(drawdown, 6) AS drawdown, round(win_rate, 6) AS win_rate"


def rounded(df):
    return df.select("agent_id", "symbol", "date", "signal", *(F.round(c, 6).alias(c) for c in ("value", "roi", "sharpe", "drawdown", "win_rate")))


@query(f"WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW} SELECT {ROUNDED} FROM shadow", "bars decisions")
def shadow_portfolio(spark, sf_dir):
    return rounded(shadows_of(spark, sf_dir))


@query(f"WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW} SELECT {ROUNDED} FROM shadow", "bars decisions")
def shadow_portfolio_segments(spark, sf_dir):
    """The same in segments of five days, so that a long series is many tasks."""
    return rounded(shadows_of(spark, sf_dir, F.floor(F.unix_date("date") / 5)))


@query(
    """WITH l AS (SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_type <> 'purchase'),
r AS (SELECT event_id AS found_id, user_id, ts AS found_at, value AS found_value FROM events WHERE event_type = 'purchase')
SELECT l.event_id, l.user_id, l.ts, found_id, found_at, found_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.found_at"""
)
def asof_join(spark, sf_dir):
    """Each event with its user's last purchase before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    found = segments.asof_join(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ("user_id",), "ts", "ts", 3 * 86_400, ("event_id",))
    return found.select("event_id", "user_id", "ts", F.col("found.event_id").alias("found_id"), F.col("found.ts").alias("found_at"), F.col("found.value").alias("found_value"))


@query(f"WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW} SELECT {ROUNDED} FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, symbol ORDER BY date DESC) AS k FROM shadow) WHERE k = 1", "bars decisions")
def latest_shadow(spark, sf_dir):
    return rounded(shadow.latest(shadows_of(spark, sf_dir), "agent_id", "symbol"))


@query(
    f"""WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW}, m AS (SELECT *, value / 100 AS v, max(value / 100) OVER (PARTITION BY agent_id, symbol ORDER BY date) AS p FROM fallen)
SELECT agent_id, symbol, round(max_by(v, date) - 1, 6) AS roi, round(CASE WHEN count(*) < 2 OR stddev_samp(step) <= 1e-12 THEN 0 ELSE avg(step) / stddev_samp(step) END, 6) AS sharpe,
       round(avg(CASE WHEN step > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(least(min(CASE WHEN p > 0 THEN v / p - 1 ELSE 0 END), 0), 6) AS drawdown, count(*) AS n FROM m GROUP BY agent_id, symbol""",
    "bars decisions",
)
def shadow_metrics(spark, sf_dir):
    found = shadow.shadow_metrics(shadows_of(spark, sf_dir), ("agent_id", "symbol"))
    return found.select("agent_id", "symbol", *(F.round(c, 6).alias(c) for c in ("roi", "sharpe", "win_rate", "drawdown")), "n")


@query(
    "SELECT symbol, date, CAST(sign(close - lag(close, 3) OVER w) AS INTEGER) AS momentum, seen_at FROM (SELECT symbol, close, date AS seen_at, lag(date, 2) OVER (PARTITION BY symbol ORDER BY date) AS date FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY seen_at)",
    "bars",
)
def momentum(spark, sf_dir):
    return returns.momentum(view(spark, sf_dir, "bars"))


HELD = "held AS (SELECT agent_id, symbol, date, signal, CAST(sum(signal) OVER (PARTITION BY agent_id, symbol ORDER BY date) AS BIGINT) AS holding FROM signals)"


@query(f"WITH {SIGNALS}, {HELD} SELECT agent_id, symbol, date, signal AS direction, holding FROM held", "decisions")
def holdings(spark, sf_dir):
    return returns.holdings(signals_of(spark, sf_dir).select("agent_id", "symbol", "date", F.col("signal").alias("direction")))


@query(
    f"""WITH {SIGNALS}, {HELD}, j AS (SELECT h.*, b.close FROM held h JOIN bars b USING (symbol, date)),
g AS (SELECT *, (close - lag(close) OVER w) * lag(holding) OVER w AS gain, row_number() OVER w AS n, lag(date, 6) OVER w AS tagged FROM j WINDOW w AS (PARTITION BY agent_id, symbol ORDER BY date))
SELECT agent_id, symbol, tagged AS date, date AS seen_at, CASE WHEN n > 7 THEN CAST(sign(round(sum(gain) OVER (PARTITION BY agent_id, symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 9)) AS INTEGER) END AS feedback FROM g""",
    "bars decisions",
)
def trade_feedback(spark, sf_dir):
    held = returns.holdings(signals_of(spark, sf_dir).select("agent_id", "symbol", "date", F.col("signal").alias("direction")))
    return returns.trade_feedback(held.join(view(spark, sf_dir, "bars").select("symbol", "date", "close"), ["symbol", "date"]))
