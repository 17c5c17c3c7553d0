"""Votes, weights and rebalanced portfolios over decisions and brand prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, portfolio, returns
from .market import PANEL, SIGNALS, signals_of
from .registry import query
from .views import view

CAPS = {"cap05": 0.05, "cap10": 0.1, "cap40": 0.4}
BRANDS = PANEL.replace("FROM bars", "FROM brand_bars").replace("JOIN bars", "JOIN brand_bars")
MOVES = "moves AS (SELECT symbol, date, close, CASE WHEN close > lag(close, 3) OVER (PARTITION BY symbol ORDER BY date) THEN 1 ELSE 0 END AS action_signal FROM panel)"
WEIGHTED = f"""raw AS (SELECT portfolio, cap, symbol, date, close, CASE WHEN action_signal > 0 THEN least(cap, 1e0 / sum(action_signal) OVER (PARTITION BY portfolio, date)) ELSE 0 END AS raw_weight
        FROM moves CROSS JOIN (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in CAPS.items())}) c(portfolio, cap)),
weighted AS (SELECT portfolio, symbol, date, close, raw_weight AS weight FROM raw)"""
GROWTH = """lagged AS (SELECT portfolio, date, weight, coalesce(lag(weight) OVER w, 0) AS before, coalesce(lag(weight) OVER w, 0) * coalesce(close / lag(close) OVER w, 0) AS grown FROM weighted WINDOW w AS (PARTITION BY portfolio, symbol ORDER BY date)),
growth AS (SELECT portfolio, date, sum(grown) AS grown, sum(before) AS before, sum(weight) AS total, count_if(weight > 0) AS n_positions, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS n FROM lagged GROUP BY portfolio, date)"""
REPORT = """peaks AS (SELECT *, equity / max(equity) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS fall FROM days)
SELECT portfolio, date, round(ln(equity), 6) AS log_equity, round(cash / equity, 6) AS cash_weight, CAST(n_positions AS BIGINT) AS n_positions, round(equity / lag(equity) OVER (PARTITION BY portfolio ORDER BY date) - 1, 6) AS daily_return,
       round(min(fall) OVER (PARTITION BY portfolio ORDER BY date), 6) AS drawdown FROM peaks"""


def moves_of(spark, sf_dir):
    panel = asof.price_panel(view(spark, sf_dir, "brand_bars"))
    rising = F.col("close") > F.lag("close", 3).over(returns.by_date("symbol"))
    return panel.select("symbol", "date", "close", F.when(rising, 1).otherwise(0).alias("action_signal"))


def weighted_of(spark, sf_dir):
    moves = moves_of(spark, sf_dir)
    made = [portfolio.target_weights(moves, cap, "date").withColumn("portfolio", F.lit(name)) for name, cap in CAPS.items()]
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out.select("portfolio", "symbol", "date", "close", "weight")


def reported(df):
    return df.select("portfolio", "date", F.when(F.col("equity") == 0, float("-inf")).otherwise(F.round(F.ln("equity"), 6)).alias("log_equity"), F.round(portfolio.quotient(F.col("cash"), F.col("equity")), 6).alias("cash_weight"), "n_positions", F.round("daily_return", 6).alias("daily_return"), F.round("drawdown", 6).alias("drawdown"))


@query(
    f"""WITH {SIGNALS}, v AS (SELECT symbol, date, CAST(sum(signal) AS BIGINT) AS score, count_if(signal = 1) AS buy, count_if(signal = -1) AS sell, count_if(signal = 0) AS hold FROM signals GROUP BY symbol, date),
a AS (SELECT *, CASE WHEN score > 0 THEN 'increase_exposure' WHEN score < 0 THEN 'decrease_exposure' ELSE 'hold_exposure' END AS action FROM v)
SELECT symbol, date, score, CAST(buy AS BIGINT) AS buy, CAST(sell AS BIGINT) AS sell, CAST(hold AS BIGINT) AS hold, action, printf('%s: buy=%d, sell=%d, hold=%d, net_signal=%d.', action, buy, sell, hold, score) AS reason FROM a""",
    "decisions",
)
def vote_allocation(spark, sf_dir):
    return portfolio.vote_allocation(signals_of(spark, sf_dir), "symbol", "date")


@query(
    f"""WITH {SIGNALS}, s AS (SELECT symbol, date, max_by(signal, agent_id) AS action_signal FROM signals GROUP BY symbol, date),
w AS (SELECT symbol, date, CASE WHEN action_signal > 0 THEN least(0.05e0, 1e0 / count_if(action_signal > 0) OVER (PARTITION BY date)) ELSE 0 END AS weight FROM s)
SELECT symbol, date, round(weight, 6) AS weight, round(greatest(0, 1 - least(1, sum(weight) OVER (PARTITION BY date))), 6) AS cash_weight FROM w""",
    "decisions",
)
def target_weights(spark, sf_dir):
    signals = signals_of(spark, sf_dir).groupBy("symbol", "date").agg(F.max_by("signal", "agent_id").alias("action_signal"))
    found = portfolio.target_weights(signals, 0.05, "date")
    return found.select("symbol", "date", F.round("weight", 6).alias("weight"), F.round("cash_weight", 6).alias("cash_weight"))


@query(
    """WITH w AS (SELECT symbol, date, CASE WHEN volume % 5 = 0 THEN NULL WHEN volume % 5 = 1 THEN -close ELSE close / 100 END AS weight FROM bars),
c AS (SELECT symbol, date, least(greatest(coalesce(weight, 0), 0), 0.4e0) AS weight FROM w), t AS (SELECT *, sum(weight) OVER (PARTITION BY date) AS total FROM c)
SELECT symbol, date, round(CASE WHEN total > 1 THEN weight / total ELSE weight END, 6) AS weight, round(greatest(0, 1 - least(1, total)), 6) AS cash_weight FROM t""",
    "bars",
)
def risk_rules(spark, sf_dir):
    raw = F.when(F.col("volume") % 5 == 0, F.lit(float("nan"))).when(F.col("volume") % 5 == 1, -F.col("close")).otherwise(F.col("close") / 100)
    found = portfolio.risk_rules(view(spark, sf_dir, "bars").select("symbol", "date", raw.alias("weight")), 0.4, "date")
    return found.select("symbol", "date", F.round("weight", 6).alias("weight"), F.round("cash_weight", 6).alias("cash_weight"))


@query(
    f"""WITH {BRANDS}, {MOVES}, {WEIGHTED}, l AS (SELECT symbol, max(date) AS date, max_by(close, date) AS price FROM brand_bars GROUP BY symbol),
p AS (SELECT symbol, max_by(volume, date) AS shares FROM brand_bars WHERE volume > 30 GROUP BY symbol)
SELECT w.symbol, round(w.weight, 6) AS weight, round(100000 * w.weight / l.price - coalesce(p.shares, 0), 4) AS trade FROM weighted w JOIN l USING (symbol) LEFT JOIN p USING (symbol) WHERE w.portfolio = 'cap10' AND w.date = (SELECT max(date) FROM brand_bars)""",
    "brand_bars",
)
def target_trades(spark, sf_dir):
    bars = view(spark, sf_dir, "brand_bars")
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    held = bars.where("volume > 30").groupBy("symbol").agg(F.max_by("volume", "date").alias("shares"))
    now = bars.agg(F.max("date").alias("date"))
    weights = portfolio.target_weights(moves_of(spark, sf_dir), 0.1, "date").join(now, "date", "left_semi").join(last, "symbol")
    return portfolio.target_trades(weights, held, 100_000.0).select("symbol", F.round("weight", 6).alias("weight"), F.round("trade", 4).alias("trade"))


@query(
    """WITH l AS (SELECT symbol, max_by(close, date) AS price FROM bars GROUP BY symbol), h AS (SELECT agent_id, symbol, CAST(sum(CASE decision WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END) AS BIGINT) AS shares FROM decisions GROUP BY agent_id, symbol)
SELECT agent_id, round(1000 + sum(shares * price), 4) AS equity FROM h JOIN l USING (symbol) GROUP BY agent_id""",
    "bars decisions",
)
def portfolio_equity(spark, sf_dir):
    last = view(spark, sf_dir, "bars").groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    held = signals_of(spark, sf_dir).groupBy("agent_id", "symbol").agg(F.sum("signal").alias("shares"))
    cash = held.select("agent_id").distinct().withColumn("cash", F.lit(1000.0))
    return portfolio.equity(held, last, cash, "agent_id").select("agent_id", F.round("equity", 4).alias("equity"))


MASTER = f"""WITH {BRANDS}, {MOVES}, {WEIGHTED}, {GROWTH},
days AS (SELECT *, 100000 * product(CASE WHEN n = 1 THEN 1 ELSE 1 - before + grown END) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity,
         100000 * product(CASE WHEN n = 1 THEN 1 ELSE 1 - before + grown END) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * (1 - total) AS cash FROM growth), {REPORT}"""


@query(MASTER, "brand_bars")
def master_portfolio(spark, sf_dir):
    return reported(portfolio.master_portfolio(weighted_of(spark, sf_dir)))


@query(MASTER, "brand_bars")
def master_portfolio_segments(spark, sf_dir):
    """The same in segments of a quarter, so that a long series is many tasks."""
    return reported(portfolio.master_portfolio(weighted_of(spark, sf_dir), segment=F.year("date") * 4 + F.quarter("date")))


@query(
    f"""WITH RECURSIVE {BRANDS}, {MOVES}, {WEIGHTED}, {GROWTH},
fold AS (SELECT portfolio, n, 100000e0 AS current, greatest(0, 100000e0 * (1 - (SELECT total FROM growth g WHERE g.portfolio = f.portfolio AND g.n = 1)) - 5) AS cash FROM growth f WHERE n = 1
         UNION ALL SELECT g.portfolio, g.n, f.current * g.grown + f.cash, greatest(0, (f.current * g.grown + f.cash) * (1 - g.total) - 5) FROM fold f JOIN growth g ON g.portfolio = f.portfolio AND g.n = f.n + 1),
days AS (SELECT g.portfolio, g.date, g.n_positions, f.current * g.total + f.cash AS equity, f.cash FROM fold f JOIN growth g USING (portfolio, n)), {REPORT}""",
    "brand_bars",
)
def master_portfolio_cost(spark, sf_dir):
    return reported(portfolio.master_portfolio_cost(weighted_of(spark, sf_dir), 5.0))
