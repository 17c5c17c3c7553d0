"""The correlation graph of brands, and node features of event symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, graph, returns, shadow
from .market import PANEL, RETURNS, SHADOW, SIGNALS, panel_of, shadows_of, signals_of
from .portfolios import BRANDS, MOVES, moves_of
from .registry import query
from .views import view

EDGES = """rets AS (SELECT symbol, date, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS ret FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)),
symbols AS (SELECT DISTINCT symbol FROM rets),
sums AS (SELECT a.symbol AS target, b.symbol AS source, count(*) AS n, sum(a.ret) AS sx, sum(b.ret) AS sy, sum(a.ret * a.ret) AS sxx, sum(b.ret * b.ret) AS syy, sum(a.ret * b.ret) AS sxy FROM rets a JOIN rets b USING (date) WHERE a.symbol <> b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
r AS (SELECT target, source, CASE WHEN n >= 2 AND sqrt(sxx - sx * sx / n) * sqrt(syy - sy * sy / n) > 1e-15 THEN (sxy - sx * sy / n) / (sqrt(sxx - sx * sx / n) * sqrt(syy - sy * sy / n)) END AS r FROM sums),
edges AS (SELECT t.symbol AS target, s.symbol AS source, CASE WHEN t.symbol = s.symbol THEN 1 WHEN abs(r) >= 0.02 THEN greatest(-1, least(1, r)) ELSE 0 END AS weight FROM symbols t CROSS JOIN symbols s LEFT JOIN r ON r.target = t.symbol AND r.source = s.symbol)"""
ATTENTION = """raw_attention AS (SELECT *, CASE WHEN target = source THEN 0 ELSE abs(weight) END AS a FROM edges),
attention AS (SELECT target, source, weight, CASE WHEN sum(a) OVER (PARTITION BY target) > 0 THEN a / sum(a) OVER (PARTITION BY target) ELSE a END AS attention FROM raw_attention)"""


def edges_of(spark, sf_dir):
    panel = asof.price_panel(view(spark, sf_dir, "brand_bars"))
    ret = returns.simple_return(F.lag("close").over(returns.by_date("symbol")), F.col("close"))
    return graph.correlation_edges(panel.select("symbol", "date", ret.alias("ret")), 0.02)


def agents_of(spark, sf_dir):
    symbols = view(spark, sf_dir, "brand_bars").select("symbol").distinct().where("symbol not like '%5'")
    return symbols.withColumn("agent_id", F.concat(F.lit("agent_"), F.replace(F.lower("symbol"), F.lit("#"), F.lit(""))))


@query(f"WITH {BRANDS}, {EDGES} SELECT target, source, round(weight, 6) AS weight FROM edges", "brand_bars")
def correlation_edges(spark, sf_dir):
    return edges_of(spark, sf_dir).select("target", "source", F.round("weight", 6).alias("weight"))


@query(f"WITH {BRANDS}, {EDGES}, {ATTENTION} SELECT target, source, round(attention, 6) AS attention FROM attention", "brand_bars")
def graph_attention(spark, sf_dir):
    return graph.attention(edges_of(spark, sf_dir)).select("target", "source", F.round("attention", 6).alias("attention"))


@query(
    f"WITH {BRANDS}, {MOVES}, {EDGES}, {ATTENTION}, s AS (SELECT symbol, max_by(action_signal, date) AS signal FROM moves GROUP BY symbol) SELECT target, round(greatest(-1, least(1, sum(attention * coalesce(signal, 0)))), 6) AS score FROM attention LEFT JOIN s ON s.symbol = source WHERE target <> source GROUP BY target",
    "brand_bars",
)
def graph_scores(spark, sf_dir):
    signals = moves_of(spark, sf_dir).groupBy("symbol").agg(F.max_by("action_signal", "date").alias("action_signal"))
    return graph.graph_scores(graph.attention(edges_of(spark, sf_dir)), signals).select("target", F.round("score", 6).alias("score"))


@query(
    f"""WITH {BRANDS}, {EDGES}, {ATTENTION}, g AS (SELECT symbol, concat('agent_', replace(lower(symbol), '#', '')) AS agent_id FROM symbols WHERE symbol NOT LIKE '%5')
SELECT s.agent_id AS source_agent_id, t.agent_id AS target_agent_id, source AS source_symbol, target AS target_symbol, round(attention, 6) AS alpha,
       printf('%s influences %s through graph attention alpha=%.4f.', source, target, attention) AS reason, 'short' AS layer, 3 AS top_k, printf('%s risk and market memory relevant to %s', source, target) AS query_text, 1 AS ttl_days
FROM attention JOIN g t ON t.symbol = target JOIN g s ON s.symbol = source WHERE target <> source AND attention >= 0.06""",
    "brand_bars",
)
def share_routes(spark, sf_dir):
    routes = graph.share_routes(graph.attention(edges_of(spark, sf_dir)), agents_of(spark, sf_dir), 0.06)
    return routes.withColumn("alpha", F.round("alpha", 6))


@query("SELECT symbol, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS text_norm, count(*) AS num_text_features FROM memories GROUP BY symbol", "memories")
def text_norms(spark, sf_dir):
    found = graph.text_norms(view(spark, sf_dir, "memories"))
    return found.select("symbol", F.round("text_norm", 6).alias("text_norm"), "num_text_features")


@query(
    f"""WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW}, last_day AS (SELECT max(date) AS date FROM bars),
q AS (SELECT p.symbol, coalesce((SELECT max_by(signal, agent_id) FROM signals s WHERE s.symbol = p.symbol AND s.date = p.date), 0) AS action_signal, p.close FROM panel p JOIN last_day USING (date)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, agent_id DESC) AS k FROM shadow) WHERE k = 1),
t AS (SELECT replace(symbol, 'L', 'U') AS symbol, avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS text_norm, count(*) AS n FROM memories GROUP BY 1)
SELECT q.symbol, action_signal, round(close, 6) AS close, round(coalesce(roi, 0), 6) AS shadow_roi, round(coalesce(drawdown, 0), 6) AS shadow_drawdown, round(coalesce(sharpe, 0), 6) AS shadow_sharpe, round(coalesce(win_rate, 0), 6) AS shadow_win_rate,
       round(coalesce(text_norm, 0), 6) AS text_norm, CAST(coalesce(n, 0) AS BIGINT) AS num_text_features FROM q LEFT JOIN l USING (symbol) LEFT JOIN t USING (symbol)""",
    "bars decisions memories",
)
def node_features(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    last = panel.join(panel.agg(F.max("date").alias("date")), "date", "left_semi")
    own = signals_of(spark, sf_dir).groupBy("symbol", "date").agg(F.max_by("signal", "agent_id").alias("action_signal"))
    quant = last.join(own, ["symbol", "date"], "left").select("symbol", F.coalesce("action_signal", F.lit(0)).alias("action_signal"), F.round("close", 6).alias("close"))
    states = shadow.latest(shadows_of(spark, sf_dir), "symbol", order=("date", "agent_id"))
    texts = graph.text_norms(view(spark, sf_dir, "memories").withColumn("symbol", F.replace("symbol", F.lit("L"), F.lit("U"))))
    found = graph.node_features(quant, states, texts)
    return found.select("symbol", "action_signal", "close", *(F.round(c, 6).alias(c) for c in ("shadow_roi", "shadow_drawdown", "shadow_sharpe", "shadow_win_rate", "text_norm")), "num_text_features")
