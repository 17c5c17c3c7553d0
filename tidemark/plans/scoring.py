"""Decisions, rules and recorded reflections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import rules, shadow
from .market import PANEL, RETURNS, SHADOW, SIGNALS, shadows_of
from .registry import query
from .views import table, view

REQUESTS = """requests AS (SELECT event_id AS request_id, concat('U', CAST(user_id AS STRING)) AS symbol, CASE event_id % 4 WHEN 0 THEN 'buy' WHEN 1 THEN ' SELL' WHEN 2 THEN 'hold' ELSE 'wait' END AS decision,
       CAST(event_id % 3 AS INTEGER) - 1 AS graph_signal, ((event_id * 37) % 101) / 100e0 AS fusion_score FROM events),
signed AS (SELECT *, lower(trim(decision)) AS word, CASE lower(trim(decision)) WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS text_signal FROM requests)"""


def requests_of(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as request_id", "concat('U', cast(user_id as string)) as symbol",
        "case event_id % 4 when 0 then 'buy' when 1 then ' SELL' when 2 then 'hold' else 'wait' end as decision",
        "cast(event_id % 3 as int) - 1 as graph_signal", "((event_id * 37) % 101) / 100e0 as fusion_score",
    )


@query(f"WITH {REQUESTS} SELECT request_id, text_signal AS signal, CASE WHEN word IN ('buy', 'hold', 'sell') THEN word ELSE 'hold' END AS normal, word IN ('buy', 'hold', 'sell') AS valid FROM signed")
def decision_signal(spark, sf_dir):
    word = F.col("decision")
    return requests_of(spark, sf_dir).select("request_id", D.decision_signal(word).alias("signal"), D.normal_decision(word).alias("normal"), D.is_valid_decision(word).alias("valid"))


@query("WITH n AS (SELECT symbol, date, lead(close) OVER (PARTITION BY symbol ORDER BY date) - close AS record FROM bars) SELECT symbol, date, CASE WHEN record > 0 THEN 1 ELSE -1 END AS direction FROM n WHERE record IS NOT NULL", "bars")
def train_actions(spark, sf_dir):
    from ..operators.returns import next_day_record

    return next_day_record(view(spark, sf_dir, "bars")).select("symbol", "date", D.train_direction(F.col("record")).alias("direction"))


@query(f"WITH {REQUESTS} SELECT request_id, CASE decision WHEN 'buy' THEN 1 WHEN 'hold' THEN 0 ELSE -1 END AS direction FROM requests")
def test_actions(spark, sf_dir):
    return requests_of(spark, sf_dir).select("request_id", D.test_direction(F.col("decision")).alias("direction"))


@query(
    f"""WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW}, s AS (SELECT agent_id, symbol, date, {", ".join(f"coalesce(CAST(round(TRY_CAST({c} AS DECIMAL(38, 9)), 4) AS DOUBLE), round({c}, 4)) AS {c}" for c in ("roi", "drawdown", "win_rate"))} FROM shadow),
f AS (SELECT *, roi <= -0.03 AS f1, drawdown <= -0.08 AS f2, win_rate <= 0.45 AND (roi < 0 OR drawdown < 0) AS f3, roi >= 0.05 AND drawdown >= -0.03 AND win_rate >= 0.55 AS g FROM s)
SELECT agent_id, symbol, date, CASE WHEN f1 OR f2 OR f3 THEN 'fear' WHEN g THEN 'greed' ELSE 'neutral' END AS state, CASE WHEN f1 OR f2 OR f3 THEN 'risk_averse' WHEN g THEN 'risk_seeking' ELSE 'balanced' END AS risk_attitude,
       CASE WHEN f1 OR f2 OR f3 THEN concat_ws('; ', CASE WHEN f1 THEN printf('ROI %.4f is below fear threshold', roi) END, CASE WHEN f2 THEN printf('drawdown %.4f is beyond fear threshold', drawdown) END, CASE WHEN f3 THEN printf('win rate %.4f is weak', win_rate) END)
            WHEN g THEN printf('ROI %.4f is above greed threshold; drawdown %.4f is controlled; win rate %.4f is strong', roi, drawdown, win_rate) ELSE 'Shadow metrics do not show a strong greed or fear regime.' END AS reason FROM f""",
    "bars decisions",
)
def psychology_state(spark, sf_dir):
    """Metrics are taken to 9 decimals and then, as decimals, half up to 4, so that the last bits of a product don't decide about a half."""
    places = lambda c: F.coalesce(F.round(F.col(c).try_cast("decimal(38, 9)"), 4).cast("double"), F.round(c, 4))
    states = shadows_of(spark, sf_dir).select("agent_id", "symbol", "date", *(places(c).alias(c) for c in ("roi", "drawdown", "win_rate")))
    return rules.psychology(states).select("agent_id", "symbol", "date", "state", "risk_attitude", "reason")


MODE = "CASE WHEN fusion_score BETWEEN 0.3e0 AND 0.7e0 OR text_signal <> graph_signal THEN 'debate' WHEN fusion_score > 0.8e0 OR fusion_score < 0.2e0 THEN 'fast_execution' ELSE 'review' END"
JUDGED = f"""judged AS (SELECT *, {MODE} AS mode, CASE WHEN fusion_score <= 0.25e0 THEN 'override_sell' WHEN word = 'buy' AND graph_signal < 0 THEN CASE WHEN fusion_score <= 0.45e0 THEN 'reduce' ELSE 'override_hold' END
       WHEN word = 'sell' AND graph_signal > 0 THEN 'reduce' WHEN fusion_score BETWEEN 0.3e0 AND 0.7e0 THEN 'reduce' ELSE 'keep' END AS verdict FROM signed),
reasoned AS (SELECT *, printf('Rule-based judge: fusion_score=%.3f, text_signal=%d, graph_signal=%d, local_decision=%s, verdict=%s.', fusion_score, text_signal, graph_signal, decision, verdict) AS reason FROM judged)"""


@query(f"WITH {REQUESTS} SELECT request_id, fusion_score BETWEEN 0.3e0 AND 0.7e0 OR text_signal <> graph_signal AS conflict, {MODE} AS mode FROM signed")
def decision_mode(spark, sf_dir):
    rows = rules.judged(requests_of(spark, sf_dir))
    return rows.select("request_id", rules.conflict(F.col("text_signal"), F.col("graph_signal"), F.col("fusion_score")).alias("conflict"), "mode")


@query(f"WITH {REQUESTS}, {JUDGED} SELECT request_id, verdict, CASE verdict WHEN 'override_sell' THEN 'sell' WHEN 'override_hold' THEN 'hold' END AS target_decision, reason FROM reasoned")
def debate_verdict(spark, sf_dir):
    return rules.judged(requests_of(spark, sf_dir)).select("request_id", "verdict", "target_decision", "reason")


@query(
    f"""WITH {REQUESTS}, {JUDGED}, c AS (SELECT event_id // 3 AS request_id, string_agg(concat(CASE WHEN event_id % 2 = 0 THEN 'short' ELSE 'long' END, ':', CAST(event_id AS STRING)), ', ' ORDER BY event_id) AS names FROM events GROUP BY 1)
SELECT request_id, symbol, printf('Graph risk conflicts with the local decision for %s. Local decision=%s, text_signal=%d, graph_signal=%d, fusion_score=%.3f. Justify the local decision using cited memory ids.', symbol, decision, text_signal, graph_signal, fusion_score) AS question,
       printf('Local decision is %s. Reason: %s. Cited memory: %s.', decision, reason, coalesce(names, 'no cited memory')) AS answer FROM reasoned LEFT JOIN c USING (request_id)"""
)
def debate_transcript(spark, sf_dir):
    refs = table(spark, sf_dir, "events").selectExpr("event_id div 3 as request_id", "case when event_id % 2 = 0 then 'short' else 'long' end as layer", "event_id as memory_id", "event_id as seq")
    return rules.transcripts(rules.judged(requests_of(spark, sf_dir)), refs)


@query(
    f"""WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW}, r AS (SELECT DISTINCT event_id, concat('agent_', event_type) AS agent_id, concat('U', CAST(user_id AS STRING)) AS symbol FROM events),
a AS (SELECT agent_id, round(max_by(roi, (date, symbol)), 6) AS roi FROM shadow WHERE agent_id <> 'agent_view' GROUP BY agent_id), s AS (SELECT symbol, round(max_by(roi, (date, agent_id)), 6) AS roi FROM shadow GROUP BY symbol)
SELECT r.event_id, r.agent_id, r.symbol, coalesce(a.roi, s.roi) AS roi FROM r LEFT JOIN a USING (agent_id) LEFT JOIN s ON s.symbol = r.symbol""",
    "bars decisions",
)
def agent_state_lookup(spark, sf_dir):
    states = shadows_of(spark, sf_dir).withColumn("roi", F.round("roi", 6))
    own = shadow.latest(states.where("agent_id != 'agent_view'").select("agent_id", "symbol", "date", "roi"), "agent_id", order=("date", "symbol"))
    other = shadow.latest(states.select("agent_id", "symbol", "date", "roi"), "symbol", order=("date", "agent_id"))
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("agent_"), "event_type").alias("agent_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"))
    return rules.agents_context(asked, own, other, "roi").select("event_id", "agent_id", "symbol", "roi")


@query(
    """WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'buy' WHEN 1 THEN 'Sell ' WHEN 2 THEN 'hold' WHEN 3 THEN NULL ELSE 'maybe' END AS d FROM events)
SELECT event_id, CASE WHEN lower(trim(d)) IN ('buy', 'sell') THEN lower(trim(d)) ELSE 'hold' END AS decision, CASE lower(trim(d)) WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS action_signal, coalesce(lower(trim(d)) IN ('buy', 'sell', 'hold'), false) AS parse_ok,
       CASE WHEN event_id % 3 = 0 THEN 'No valid LLM reflection output; defaulting to hold.' ELSE concat('because ', CAST(event_id AS STRING)) END AS reason,
       array_to_string(list_concat(CASE WHEN event_id % 4 = 0 THEN [] ELSE [concat('short:', CAST(event_id AS STRING))] END, [concat('long:', CAST(event_id % 10 AS STRING))]), ',') AS memory_refs FROM b"""
)
def reflection_signals(spark, sf_dir):
    text = F.to_json(F.struct(
        F.expr("case event_id % 5 when 0 then 'buy' when 1 then 'Sell ' when 2 then 'hold' when 3 then null else 'maybe' end").alias("investment_decision"),
        F.expr("case when event_id % 3 = 0 then null else concat('because ', cast(event_id as string)) end").alias("summary_reason"),
        F.expr("array(named_struct('memory_index', case when event_id % 4 = 0 then -1 else event_id end), named_struct('memory_index', cast(null as bigint)))").alias("short_memory_index"),
        F.expr("array(named_struct('memory_index', event_id % 10))").alias("long_memory_index"),
    ))
    rows = rules.reflections(table(spark, sf_dir, "events").select("event_id", text.alias("reflection")))
    return rows.withColumn("memory_refs", F.array_join("memory_refs", ",")).select("event_id", "decision", "action_signal", "parse_ok", "reason", "memory_refs")
