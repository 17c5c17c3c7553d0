"""Votes, target weights, risk rules, trades and the rebalanced master portfolio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import normal_decision
from . import segments


def vote_allocation(signals: DataFrame, *keys: str) -> DataFrame:
    """Sum of signals, the exposure it calls for, and counts of normalised decisions, with the reason as text."""
    word = normal_decision(F.col("decision"))
    counts = [F.count_if(word == w).alias(w) for w in ("buy", "sell", "hold")]
    votes = signals.groupBy(*keys).agg(F.sum("signal").cast("long").alias("score"), *counts)
    action = F.when(F.col("score") > 0, "increase_exposure").when(F.col("score") < 0, "decrease_exposure").otherwise("hold_exposure")
    reason = F.format_string("%s: buy=%d, sell=%d, hold=%d, net_signal=%d.", "action", "buy", "sell", "hold", "score")
    return votes.withColumn("action", action).withColumn("reason", reason)


def safe_weight(weight: Column) -> Column:
    """Null, NaN, infinite and negative weights are 0."""
    bad = weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(weight, F.lit(0.0)))


def risk_rules(weights: DataFrame, max_weight: float, *keys: str) -> DataFrame:
    """Cleans and caps ``weight``, scales a key's weights to 1 if they sum to more, and adds the cash that is left."""
    every = Window.partitionBy(*keys)
    capped = weights.withColumn("weight", F.least(safe_weight(F.col("weight")), F.lit(max(0.0, max_weight))))
    total = F.sum("weight").over(every)
    scaled = capped.withColumn("_total", total).withColumn("weight", F.when(F.col("_total") > 1, F.col("weight") / F.col("_total")).otherwise(F.col("weight")))
    return scaled.withColumn("cash_weight", F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), "_total"))).drop("_total")


def target_weights(signals: DataFrame, max_weight: float, *keys: str) -> DataFrame:
    """Equal weights over a key's symbols with a positive ``action_signal``, then the risk rules."""
    positive = F.count_if(F.col("action_signal") > 0).over(Window.partitionBy(*keys))
    raw = F.when(F.col("action_signal") > 0, 1 / positive).otherwise(0.0)
    return risk_rules(signals.withColumn("weight", raw), max_weight, *keys)


def target_trades(weights: DataFrame, positions: DataFrame, equity: float) -> DataFrame:
    """Shares to trade: equity * weight / price less the shares held (missing: 0); a price that isn't positive is an error."""
    joined = weights.join(positions, "symbol", "left")
    checked = F.when(F.col("price") > 0, F.col("price")).otherwise(F.raise_error(F.concat(F.lit("price must be positive for "), F.col("symbol"))).cast("double"))
    return joined.withColumn("trade", equity * F.col("weight") / checked - F.coalesce("shares", F.lit(0.0)))


def equity(positions: DataFrame, prices: DataFrame, cash: DataFrame, *keys: str) -> DataFrame:
    """Cash and the value of the priced shares of each key."""
    held = positions.join(prices, "symbol").groupBy(*keys).agg(F.sum(F.col("shares") * F.col("price")).alias("invested"))
    return cash.join(held, list(keys), "left").withColumn("equity", F.col("cash") + F.coalesce("invested", F.lit(0.0)))


def _growth(weighted: DataFrame) -> DataFrame:
    """(portfolio, date, grown, total): what a unit invested at the last date's weights has become, and the new weights' sum."""
    w = Window.partitionBy("portfolio", "symbol").orderBy("date")
    before = F.coalesce(F.lag("weight").over(w), F.lit(0.0))
    grown = before * F.coalesce(F.col("close") / F.lag("close").over(w), F.lit(0.0))
    rows = weighted.select("portfolio", "date", "weight", before.alias("before"), grown.alias("grown"))
    return rows.groupBy("portfolio", "date").agg(F.sum("grown").alias("grown"), F.sum("before").alias("before"), F.sum("weight").alias("total"), F.count_if(F.col("weight") > 0).alias("n_positions"))


def quotient(a: Column, b: Column) -> Column:
    """a / b; by 0 no number."""
    return F.when(b == 0, float("nan")).otherwise(F.try_divide(a, b))


def _report(days: DataFrame) -> DataFrame:
    """Adds daily_return and drawdown; after a date without equity the return is no number."""
    w = Window.partitionBy("portfolio").orderBy("date")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    fall = days.withColumn("daily_return", quotient(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("fall", F.col("equity") / peak - 1)
    return fall.withColumn("drawdown", F.min("fall").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fall")


def master_portfolio(weighted: DataFrame, initial: float = 100_000.0, segment: Column | None = None) -> DataFrame:
    """Equity, cash, daily return and drawdown of portfolios rebalanced at each date without cost.

    weighted: (portfolio, date, symbol, close, weight), weights of a date summing to 1 at most. A date's growth is the
    cash share plus the grown weights of the date before, and equity is the running product of growth. With ``segment``,
    which never falls with the date, a portfolio's dates are many tasks.
    """
    if segment is not None:
        days = _growth(weighted)
        opening = days.groupBy(F.col("portfolio").alias("_portfolio")).agg(F.min("date").alias("_first"))
        days = days.join(opening, F.col("portfolio").eqNullSafe(F.col("_portfolio")))
        step = F.when(F.col("date") > F.col("_first"), F.col("grown") - F.col("before"))
        days = days.withColumn("daily_return", step).withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("segment", segment)
        days = segments.scan(days, ("portfolio",), ("date",), initial=initial)
        return days.select("portfolio", "date", F.col("value").alias("equity"), (F.col("value") * (1 - F.col("total"))).alias("cash"), "n_positions", "daily_return", "drawdown")
    w = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("portfolio").orderBy("date")) == 1
    growth = F.when(first, 1.0).otherwise(1 - F.col("before") + F.col("grown"))
    days = _growth(weighted).withColumn("growth", growth).withColumn("equity", initial * F.product("growth").over(w))
    return _report(days.withColumn("cash", F.col("equity") * (1 - F.col("total")))).select("portfolio", "date", "equity", "cash", "n_positions", "daily_return", "drawdown")


def master_portfolio_cost(weighted: DataFrame, cost: float, initial: float = 100_000.0) -> DataFrame:
    """As ``master_portfolio`` with a fixed cost at each rebalance, taken from cash that never falls below 0.

    The floor makes each date depend on the last, so a portfolio's dates (not its symbols) are folded in order in one group.
    A portfolio that can't pay the cost loses its cash, and what isn't invested then is lost too, until its equity is 0; what
    is relative to that is no number.
    """

    def fold(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date")
        equities, cashes, held = [], [], None
        for grown, total in zip(days["grown"], days["total"], strict=True):
            current = initial if held is None else held[0] * grown + held[1]
            cash = max(0.0, current - current * total - cost)
            equities.append(current * total + cash)
            cashes.append(cash)
            held = current, cash
        return days.assign(equity=equities, cash=cashes)[["portfolio", "date", "equity", "cash", "n_positions"]]

    days = _growth(weighted).groupBy("portfolio").applyInPandas(fold, "portfolio string, date date, equity double, cash double, n_positions long")
    return _report(days).select("portfolio", "date", "equity", "cash", "n_positions", "daily_return", "drawdown")
