"""Strategy evaluation: each agent is a model, its signals are the actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import decision_signal
from ..operators import evaluate, returns
from .market import SIGNALS, signals_of
from .registry import query
from .views import view

REWARDS = f"""{SIGNALS}, priced AS (SELECT symbol, date, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS next_close, close FROM bars),
rewards AS (SELECT s.agent_id AS model, symbol, date, s.signal * ln(next_close / close) AS reward FROM signals s JOIN priced USING (symbol, date) WHERE close > 0 AND next_close > 0)"""
CURVES = "curves AS (SELECT *, sum(reward) OVER (PARTITION BY model, symbol ORDER BY date) AS cumulative FROM rewards)"
METRICS = """metrics AS (SELECT model, symbol, sum(reward) AS cumulative, stddev_samp(reward) AS std, count(*) + 1 AS n_prices, stddev_samp(reward) * sqrt(252) AS volatility,
       CASE WHEN stddev_samp(reward) * sqrt(252) > 1e-12 THEN sum(reward) / ((count(*) + 1) / 252e0) / (stddev_samp(reward) * sqrt(252)) END AS sharpe FROM rewards GROUP BY model, symbol)"""
DRAWDOWN = """curve AS (SELECT *, product(1 + reward) OVER w AS value FROM rewards WINDOW w AS (PARTITION BY model, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
peaks AS (SELECT *, greatest(1e0, max(value) OVER (PARTITION BY model, symbol ORDER BY date)) AS peak FROM curve),
drawdowns AS (SELECT model, symbol, max((peak - value) / peak) AS max_drawdown FROM peaks GROUP BY model, symbol)"""
MODELS = ["agent_click", "agent_error", "agent_purchase", "agent_signup", "agent_view", "buy_and_hold"]


def actions_of(spark, sf_dir):
    return signals_of(spark, sf_dir).select(F.col("agent_id").alias("model"), "symbol", "date", F.col("signal").alias("action"))


def rewards_of(spark, sf_dir):
    return returns.daily_reward(view(spark, sf_dir, "bars"), actions_of(spark, sf_dir))


@query(f"WITH {REWARDS} SELECT model, symbol, date, round(reward, 6) AS reward FROM rewards", "bars decisions")
def daily_reward(spark, sf_dir):
    return rewards_of(spark, sf_dir).select("model", "symbol", "date", F.round("reward", 6).alias("reward"))


@query(
    f"""WITH {SIGNALS}, p AS (SELECT symbol, row_number() OVER w AS n, close, lead(close) OVER w AS next_close FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
a AS (SELECT *, row_number() OVER (PARTITION BY agent_id, symbol ORDER BY date) AS n FROM signals)
SELECT agent_id AS model, symbol, a.date, round(signal * ln(next_close / close), 6) AS reward FROM a JOIN p USING (symbol, n) WHERE close > 0 AND next_close > 0""",
    "bars decisions",
)
def daily_reward_positional(spark, sf_dir):
    rows = returns.daily_reward(view(spark, sf_dir, "bars"), actions_of(spark, sf_dir), strict_positional=True)
    return rows.select("model", "symbol", "date", F.round("reward", 6).alias("reward"))


@query(f"WITH {REWARDS}, {CURVES} SELECT model, symbol, date, round(cumulative, 6) AS cumulative FROM curves", "bars decisions")
def cumulative_reward(spark, sf_dir):
    return returns.cumulative_reward(rewards_of(spark, sf_dir)).select("model", "symbol", "date", F.round("cumulative", 6).alias("cumulative"))


@query(f"WITH {REWARDS}, {METRICS} SELECT model, symbol, round(cumulative, 6) AS cumulative, round(std, 6) AS std, n_prices, round(volatility, 6) AS volatility, round(sharpe, 4) AS sharpe FROM metrics", "bars decisions")
def strategy_metrics(spark, sf_dir):
    found = evaluate.strategy_metrics(rewards_of(spark, sf_dir))
    return found.select("model", "symbol", F.round("cumulative", 6).alias("cumulative"), F.round("std", 6).alias("std"), "n_prices", F.round("volatility", 6).alias("volatility"), F.round("sharpe", 4).alias("sharpe"))


@query(f"WITH {REWARDS}, {DRAWDOWN} SELECT model, symbol, round(max_drawdown, 5) AS max_drawdown FROM drawdowns", "bars decisions")
def strategy_max_drawdown(spark, sf_dir):
    return evaluate.max_drawdown(rewards_of(spark, sf_dir)).select("model", "symbol", F.round("max_drawdown", 5).alias("max_drawdown"))


@query(
    """WITH c AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM brand_bars)
SELECT symbol, round(max(close) - min(close), 6) AS price_range, round(stddev_samp(CASE WHEN before > 0 THEN close / before - 1 END), 6) AS std_change FROM c GROUP BY symbol""",
    "brand_bars",
)
def price_dispersion(spark, sf_dir):
    found = evaluate.price_dispersion(view(spark, sf_dir, "brand_bars"))
    return found.select("symbol", F.round("price_range", 6).alias("price_range"), F.round("std_change", 6).alias("std_change"))


@query(
    f"""WITH {REWARDS}, {CURVES}, v AS (SELECT model, symbol, date, round(cumulative, 9) AS x FROM curves),
d AS (SELECT symbol, p.model AS a, q.model AS b, round(p.x - q.x, 9) AS d FROM v p JOIN v q USING (symbol, date) WHERE p.model < q.model),
r AS (SELECT symbol, a, b, d, rank() OVER w + (count(*) OVER (PARTITION BY symbol, a, b, abs(d)) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY symbol, a, b, abs(d)) AS t FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY symbol, a, b ORDER BY abs(d))),
s AS (SELECT symbol, a, b, count(*)::DOUBLE AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w, sum(t * t - 1)::DOUBLE AS tied FROM r GROUP BY symbol, a, b),
z AS (SELECT *, CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - tied / 48 > 0 THEN abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) END / sqrt(2e0) AS x FROM s),
e AS (SELECT *, 1 / (1 + 0.3275911e0 * x) AS t FROM z)
SELECT symbol, a, b, CAST(n AS BIGINT) AS n, w, round(t * (0.254829592e0 + t * (-0.284496736e0 + t * (1.421413741e0 + t * (-1.453152027e0 + t * 1.061405429e0)))) * exp(-x * x), 6) AS p FROM e""",
    "bars decisions",
)
def wilcoxon_pairs(spark, sf_dir):
    found = evaluate.wilcoxon_pairs(returns.cumulative_reward(rewards_of(spark, sf_dir)))
    return found.select("symbol", "a", "b", "n", "w", F.round("p", 6).alias("p"))


_PIVOT = ", ".join(f"round(max(CASE WHEN model = '{m}' THEN value END), 4) AS {m}" for m in MODELS)


@query(
    f"""WITH {SIGNALS.replace("FROM decisions)", "FROM decisions UNION ALL SELECT 'buy_and_hold', symbol, date, 1 FROM bars)")}, {REWARDS[len(SIGNALS) + 2:]}, {METRICS},
long AS (SELECT symbol, model, 'cumulative' AS metric, cumulative AS value FROM metrics UNION ALL SELECT symbol, model, 'sharpe', sharpe FROM metrics UNION ALL SELECT symbol, model, 'volatility', volatility FROM metrics)
SELECT symbol, metric, {_PIVOT} FROM long GROUP BY symbol, metric""",
    "bars decisions",
)
def model_comparison(spark, sf_dir):
    bars = view(spark, sf_dir, "bars")
    hold = bars.select(F.lit("buy_and_hold").alias("model"), "symbol", "date", F.lit(1).alias("action"))
    metrics = evaluate.strategy_metrics(returns.daily_reward(bars, actions_of(spark, sf_dir).unionByName(hold)))
    found = evaluate.comparison(metrics, MODELS, ["cumulative", "sharpe", "volatility"])
    return found.select("symbol", "metric", *(F.round(m, 4).alias(m) for m in MODELS))
