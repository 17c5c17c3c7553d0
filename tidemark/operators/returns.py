"""Returns, labels, rewards and signals over price panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def so_far(*keys: str):
    return by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)


def simple_return(before: Column, after: Column) -> Column:
    """after / before - 1; null if a price is missing or before isn't positive."""
    return F.when(before > 0, after / before - 1)


def log_return(before: Column, after: Column) -> Column:
    return F.when((before > 0) & (after > 0), F.ln(after / before))


def label(ret: Column, threshold: float = 0.0) -> Column:
    """1 above the threshold, -1 below its negative, else 0; null for a null return."""
    return F.when(ret.isNull(), F.lit(None).cast("int")).when(ret > threshold, 1).when(ret < -threshold, -1).otherwise(0)


def quant_features(panel: DataFrame, signals: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Next-day return and label on a filled panel, with each symbol's action signal (missing: 0).

    signals: (symbol, date, action_signal, seq); of several agents the largest seq wins.
    """
    own = signals.groupBy("symbol", "date").agg(F.max_by("action_signal", "seq").alias("signal"))
    ahead = F.lead("close").over(by_date("symbol"))
    rows = panel.withColumn("next_close", ahead).withColumn("ret", simple_return(F.col("close"), F.col("next_close")))
    rows = rows.withColumn("label", label(F.col("ret"), threshold)).withColumn("has_next_price", F.col("next_close").isNotNull())
    return rows.join(own, ["symbol", "date"], "left").withColumn("action_signal", F.coalesce("signal", F.lit(0))).drop("signal", "next_close")


def next_day_record(panel: DataFrame) -> DataFrame:
    """Price difference to the next date; a symbol's last date is left out."""
    ahead = F.lead("close").over(by_date("symbol"))
    return panel.withColumn("record", ahead - F.col("close")).where("record is not null")


def daily_reward(prices: DataFrame, actions: DataFrame, strict_positional: bool = False) -> DataFrame:
    """(model, symbol, date, reward): action times the log return to the next bar.

    Actions (model, symbol, date, action) meet prices by date, or by their ordinal number if ``strict_positional``.
    """
    reward = log_return(F.col("close"), F.lead("close").over(by_date("symbol")))
    priced = prices.select("symbol", "date", reward.alias("log_return"))
    if strict_positional:
        priced = priced.withColumn("n", F.row_number().over(by_date("symbol"))).drop("date")
        actions = actions.withColumn("n", F.row_number().over(by_date("model", "symbol")))
        joined = actions.join(priced, ["symbol", "n"])
    else:
        joined = actions.join(priced, ["symbol", "date"])
    return joined.where("log_return is not null").select("model", "symbol", "date", (F.col("action") * F.col("log_return")).alias("reward"))


def cumulative_reward(rewards: DataFrame) -> DataFrame:
    return rewards.withColumn("cumulative", F.sum("reward").over(so_far("model", "symbol")))


def momentum(bars: DataFrame, k: int = 3) -> DataFrame:
    """Sign of the last k price differences' sum, tagged with the date of row -(k-1); null until there are k differences."""
    w = by_date("symbol")
    return bars.select("symbol", F.lag("date", k - 1).over(w).alias("date"), F.signum(F.col("close") - F.lag("close", k).over(w)).cast("int").alias("momentum"), F.col("date").alias("seen_at"))


def holdings(actions: DataFrame) -> DataFrame:
    """Running sum of directions."""
    return actions.withColumn("holding", F.sum("direction").over(so_far("agent_id", "symbol")))


def trade_feedback(held: DataFrame, window: int = 7) -> DataFrame:
    """Sign of the last ``window`` days' sum of price change times the holding before it; null until there are so many.

    held: (agent_id, symbol, date, close, holding). Tagged with the date of row -(window-1).
    """
    w = by_date("agent_id", "symbol")
    gain = (F.col("close") - F.lag("close").over(w)) * F.lag("holding").over(w)
    rows = held.withColumn("gain", gain).withColumn("n", F.row_number().over(w))
    last = w.rowsBetween(-(window - 1), 0)
    total = F.when(F.col("n") > window, F.signum(F.round(F.sum("gain").over(last), 9)).cast("int"))
    return rows.select("agent_id", "symbol", F.lag("date", window - 1).over(w).alias("date"), F.col("date").alias("seen_at"), total.alias("feedback"))
