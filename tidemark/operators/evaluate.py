"""Evaluation of strategies: reward metrics, drawdown, dispersion and the signed-rank test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .returns import so_far

TRADING_DAYS = 252


def strategy_metrics(rewards: DataFrame, risk_free: float = 0.0, strict: bool = False) -> DataFrame:
    """Cumulative log reward, sample deviation, annual volatility, Sharpe ratio and number of prices of each (model, symbol).

    Without volatility the ratio is null, or an error if ``strict``.
    """
    found = rewards.groupBy("model", "symbol").agg(F.sum("reward").alias("cumulative"), F.stddev_samp("reward").alias("std"), (F.count("*") + 1).alias("n_prices"))
    found = found.withColumn("volatility", F.col("std") * math.sqrt(TRADING_DAYS))
    annual = F.col("cumulative") / (F.col("n_prices") / TRADING_DAYS) - risk_free
    none = F.raise_error(F.lit("volatility is zero")).cast("double") if strict else F.lit(None).cast("double")
    return found.withColumn("sharpe", F.when(F.col("volatility") > 1e-12, annual / F.col("volatility")).otherwise(none))


def max_drawdown(rewards: DataFrame) -> DataFrame:
    """Largest fall below the running peak of the product of 1 + reward, a curve that starts at 1; positive."""
    w = so_far("model", "symbol")
    curve = rewards.withColumn("value", F.product(1 + F.col("reward")).over(w))
    peak = F.greatest(F.lit(1.0), F.max("value").over(w))
    return curve.withColumn("peak", peak).groupBy("model", "symbol").agg(F.max((F.col("peak") - F.col("value")) / F.col("peak")).alias("max_drawdown"))


def price_dispersion(bars: DataFrame) -> DataFrame:
    """Range of a symbol's prices and sample deviation of its relative changes."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    change = F.when(before > 0, F.col("close") / before - 1)
    return bars.withColumn("change", change).groupBy("symbol").agg((F.max("close") - F.min("close")).alias("price_range"), F.stddev_samp("change").alias("std_change"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a rational approximation (absolute error below 2e-7)."""
    #: Abramowitz and Stegun 7.1.26.
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = t * (c + poly)
    return poly * F.exp(-x * x)


def wilcoxon_pairs(curves: DataFrame) -> DataFrame:
    """Signed-rank test of every pair of models (a < b) on their cumulative rewards of a symbol.

    Zero differences are dropped, ties share their average rank, W is the smaller rank sum, and p is the two-sided
    normal approximation with tie correction. Models meet by date, so pairs are made of a symbol's few models only.
    """
    value = F.round("cumulative", 9)
    a = curves.select("symbol", "date", F.col("model").alias("a"), value.alias("x"))
    b = curves.select("symbol", "date", F.col("model").alias("b"), value.alias("y"))
    gaps = a.join(b, ["symbol", "date"]).where("a < b").withColumn("d", F.round(F.col("x") - F.col("y"), 9)).where("d != 0")
    size = F.abs("d")
    keys = ("symbol", "a", "b")
    ties = gaps.groupBy(*keys, size.alias("size")).agg(F.count("*").alias("t"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    below = F.sum("t").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")
    ranked = ties.withColumn("rank", below + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(t * t * t - t).alias("tied"))
    n = F.col("n").cast("double")
    w = F.least("plus", "minus")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48
    z = F.when(variance > 0, F.abs(w - n * (n + 1) / 4) / F.sqrt(variance))
    return sums.select(*keys, "n", w.alias("w"), erfc(z / math.sqrt(2)).alias("p"))


def comparison(metrics: DataFrame, models: list[str], names: list[str]) -> DataFrame:
    """metrics (symbol, model, ...) as one row per symbol and metric, one column per model."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names)))
    long = metrics.select("symbol", "model", pairs.alias("pair")).select("symbol", "model", "pair.*")
    return long.groupBy("symbol", "metric").pivot("model", models).agg(F.first("value"))
