"""Shadow portfolios: what an agent's signals would have earned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments
from .returns import so_far

TINY = 1e-12


def shadow_portfolio(signals: DataFrame, initial: float = 100.0, keys: tuple[str, ...] = ("agent_id", "symbol"), segment: Column | None = None) -> DataFrame:
    """Value after each date (v = v_before * (1 + signal * return), null return 0) with expanding metrics.

    signals: keys, date, signal, ret. Three windows of one partitioning: value, then its peak, then the drawdown.
    The peak starts at the first value after an update. With ``segment``, which never falls with the date, a key's
    series is many tasks (``segments.scan``), for series that are too long for one; a null signal is then 0.
    """
    w = so_far(*keys)
    step = signals.withColumn("step", F.col("signal") * F.coalesce("ret", F.lit(0.0)))
    if segment is not None:
        scanned = segments.scan(step.withColumn("segment", segment).fillna(0.0, ["step"]), keys, ("date",), initial=initial)
        return _metrics(scanned, initial, keys)
    valued = step.withColumn("value", initial * F.product(1 + F.col("step")).over(w))
    n, spread = F.count("step").over(w), F.stddev_samp("step").over(w)
    valued = valued.withColumn("n", n).withColumn("spread", spread).withColumn("mean", F.avg("step").over(w)).withColumn("win_rate", F.avg(F.when(F.col("step") > 0, 1.0).otherwise(0.0)).over(w))
    peaked = valued.withColumn("peak", F.max("value").over(w))
    fall = F.when(F.col("peak") > 0, F.col("value") / F.col("peak") - 1).otherwise(0.0)
    return _metrics(peaked.withColumn("drawdown", F.min(fall).over(w)), initial, keys)


def _metrics(fallen: DataFrame, initial: float, keys: tuple[str, ...]) -> DataFrame:
    sharpe = F.when((F.col("n") < 2) | (F.col("spread") <= TINY), 0.0).otherwise(F.try_divide("mean", "spread"))
    change = F.col("value") / initial - 1
    return fallen.select(*keys, "date", "signal", "step", "value", change.alias("roi"), change.alias("rolling_return"), sharpe.alias("sharpe"), "drawdown", "win_rate")


def shadow_metrics(returns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """ROI, compounded return, Sharpe ratio, win rate and drawdown of each key's returns (``date``, ``step``) as aggregates."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    finite = returns.where("step is not null and not isnan(step) and abs(step) < double('infinity')")
    curve = finite.withColumn("value", F.product(1 + F.col("step")).over(w)).withColumn("peak", F.max("value").over(w))
    fall = F.when(F.col("peak") > 0, F.col("value") / F.col("peak") - 1).otherwise(0.0)
    sharpe = F.when((F.count("step") < 2) | (F.stddev_samp("step") <= TINY), 0.0).otherwise(F.try_divide(F.avg("step"), F.stddev_samp("step")))
    return curve.groupBy(*keys).agg((F.max_by("value", "date") - 1).alias("roi"), sharpe.alias("sharpe"), F.avg(F.when(F.col("step") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.least(F.min(fall), F.lit(0.0)).alias("drawdown"), F.count("step").alias("n"))


def latest(states: DataFrame, *keys: str, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """The last state of each key."""
    rest = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")
