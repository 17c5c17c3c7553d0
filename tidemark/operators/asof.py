"""As-of panels: the latest bar on every date, cumulative counts, and the next trading day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments


def latest_bar(bars: DataFrame, day: str) -> DataFrame:
    """Each symbol's last bar on or before a day, in one aggregation."""
    rest = [c for c in bars.columns if c != "symbol"]
    last = F.max_by(F.struct(*rest), "date").alias("bar")
    return bars.where(F.col("date") <= F.lit(day).cast("date")).groupBy("symbol").agg(last).select("symbol", "bar.*")


def calendar_grid(lives: DataFrame, dates: DataFrame) -> DataFrame:
    """Every date of the calendar from each life's ``first`` on, with its year as ``segment``; years are joined, not ranges."""
    years = dates.where("date is not null").groupBy(F.year("date").alias("segment")).agg(F.collect_set("date").alias("days"))  # at most 366
    own = F.sequence(F.year("first"), years.agg(F.max("segment")).scalar())
    asked = lives.where(F.col("first").isNotNull()).withColumn("segment", F.explode(own))
    return asked.join(years, "segment").withColumn("date", F.explode(F.filter("days", lambda d: d >= F.col("first")))).drop("days", "first")


def price_panel(bars: DataFrame) -> DataFrame:
    """(symbol, date, close, bar_date) for every date of the calendar from a symbol's first bar on; missing bars carry the last one.

    The calendar is joined to each symbol's life by years. Gaps are filled within a year of a symbol, and a year starts
    with what the years before it ended with.
    """
    grid = calendar_grid(bars.groupBy("symbol").agg(F.min("date").alias("first")), bars.select("date").distinct())
    own = bars.select("symbol", "date", "close", F.col("date").alias("bar_date"))
    filled = segments.last_known(grid.join(own, ["symbol", "date"], "left"), ("symbol",), ("date",), "close", "bar_date")
    return filled.select("symbol", "date", "close", "bar_date")


def counts_so_far(panel: DataFrame, feed: DataFrame, name: str) -> DataFrame:
    """Adds the rows of a feed available by the end of each date, since the beginning: counts by day, then a running sum."""
    days = feed.groupBy("symbol", F.col("available_at").cast("date").alias("date")).agg(F.count("*").alias("_n"))
    marks = panel.select("symbol", "date", F.lit(True).alias("_real"))
    both = marks.join(days, ["symbol", "date"], "full")
    so_far = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = both.withColumn(name, F.coalesce(F.sum("_n").over(so_far), F.lit(0)).cast("long")).where("_real").select("symbol", "date", name)
    return panel.join(running, ["symbol", "date"])


def texts_so_far(panel: DataFrame, feed: DataFrame, text_id: str) -> DataFrame:
    """One row for each panel row and each text available by the end of its date (the texts themselves, asked for by name)."""
    feed = feed.select("symbol", text_id, "available_at")
    return panel.select("symbol", "date").join(feed, "symbol").where(F.col("available_at").cast("date") <= F.col("date"))


def next_trading_day(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Maps each of ``dates`` to the first calendar date on or after it; null past the end.

    Both sides are distinct dates (a few thousand in a decade), so one ordered pass over them is small.
    """
    both = dates.select("date", F.lit(None).cast("date").alias("open")).union(calendar.select("date", F.col("date").alias("open")))
    ahead = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    days = both.groupBy("date").agg(F.max("open").alias("open"))
    return days.withColumn("trading_date", F.first("open", True).over(ahead)).join(dates.select("date").distinct(), "date", "left_semi").select("date", "trading_date")


def outside_calendar(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Dates that the calendar doesn't have."""
    return dates.select("date").distinct().join(calendar.select("date"), "date", "left_anti")


def session_date(ts: Column) -> Column:
    """The day a text counts for: from 16:00 on the next one."""
    return F.when(F.hour(ts) >= 16, F.date_add(ts.cast("date"), 1)).otherwise(ts.cast("date"))


def session_stamp(ts: Column) -> Column:
    """09:00 of the next day after 16:00:00, else of the same day."""
    late = (F.hour(ts) >= 16) & ((F.minute(ts) > 0) | (F.floor(F.second(ts)) > 0))
    day = F.when(late, F.date_add(ts.cast("date"), 1)).otherwise(ts.cast("date"))
    return day.cast("timestamp_ntz") + F.expr("INTERVAL '9' HOUR")
