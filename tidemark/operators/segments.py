"""Long series by segments: what a row needs of all earlier rows, without a key's rows in one task.

A series (key) is cut into segments by a column ``segment`` that never falls with the order, such as the month of a date
or ``span`` of a time. Each segment is summed up in one row; a window over those few rows carries the past into each
segment; and a window within the segment does the rest. A key with very many rows is as many groups as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = "_before"


def span(time: Column | str, seconds: int) -> Column:
    """The number of the span of so many seconds that a time, or date, is in."""
    return F.floor(F.unix_seconds(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp")) / seconds)


def _carry(ends: DataFrame, keys: tuple[str, ...], carried: dict[str, Column]) -> DataFrame:
    """Adds columns over a key's earlier segments; ``carried`` are aggregates of the segments' rows."""
    past = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "segment", *(c.over(past).alias(f"{BEFORE}_{name}") for name, c in carried.items()))


def _with_carry(rows: DataFrame, carry: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Joined on all keys (a null key is a key) and the segment."""
    names = [c for c in carry.columns if c.startswith(BEFORE)]
    other = carry.select(*(F.col(c).alias(f"_key_{c}") for c in (*keys, "segment")), *names)
    on = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in (*keys, "segment")]
    return rows.join(other, on, "left").drop(*(f"_key_{c}" for c in (*keys, "segment")))


def last_known(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], *known: str) -> DataFrame:
    """Each of ``known`` (null where a row tells nothing) filled with the last one at or before each row of the key.

    rows: the keys, ``segment``, order and known. Rows of equal order may be taken in any order.
    """
    within = Window.partitionBy(*keys, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = lambda c, x: F.when(F.col(c).isNotNull(), x)
    ends = rows.groupBy(*keys, "segment").agg(*(F.max_by(told(c, F.col(c)), told(c, F.struct(*order))).alias(c) for c in known))
    carry = _carry(ends, keys, {c: F.last(c, True) for c in known})
    filled = _with_carry(rows.withColumns({c: F.last(c, True).over(within) for c in known}), carry, keys)
    return filled.withColumns({c: F.coalesce(c, f"{BEFORE}_{c}") for c in known}).drop(*(f"{BEFORE}_{c}" for c in known))


def previous(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], known: str, into: str) -> DataFrame:
    """Adds the column of the row before, in the key's order; null for the first. rows: keys, ``segment``, order and known."""
    within = Window.partitionBy(*keys, "segment").orderBy(*order)
    ends = rows.groupBy(*keys, "segment").agg(F.max_by(F.struct(F.col(known).alias("last")), F.struct(*order)).alias("end"))
    filled = _with_carry(rows.withColumns({into: F.lag(known).over(within), "_nth": F.row_number().over(within)}), _carry(ends, keys, {"end": F.last("end", True)}), keys)
    return filled.withColumn(into, F.when(F.col("_nth") > 1, F.col(into)).otherwise(F.col(f"{BEFORE}_end")["last"])).drop("_nth", f"{BEFORE}_end")


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_time: str, right_time: str, seconds: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``left`` with ``found``: the columns of the last row of ``right`` (a struct) with its keys whose time isn't later.

    Both sides are one series, sorted by time in segments of so many seconds; no range is joined. Of rows of one time the
    one with the largest ``ties`` counts, and it is there for rows of ``left`` of that time. Without one ``found`` is
    null. Rows with a null time find nothing and aren't found; a null key is a key. Repeated rows of ``left`` all stay.
    """
    own = F.struct(*(F.col(c) for c in left.columns))
    what = F.struct(*(F.col(c) for c in right.columns))
    tied = lambda side: F.struct(*(F.col(c) if side else F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in ties), F.lit(1 if side else 2).alias("_side"))
    asks = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_asks"), tied(False).alias("_tie"), own.alias("_own"), F.lit(None).cast(right.select(what.alias("x")).schema["x"].dataType).alias("found"))
    tells = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_asks"), tied(True).alias("_tie"), F.lit(None).cast(asks.schema["_own"].dataType).alias("_own"), what.alias("found"))
    both = tells.unionByName(asks.where("_time is not null")).withColumn("segment", span("_time", seconds))
    filled = last_known(both, keys, ("_time", "_asks", "_tie"), "found").where("_asks = 1")
    timeless = asks.where("_time is null")
    return filled.select("_own", "found").unionByName(timeless.select("_own", "found")).select("_own.*", "found")


def scan(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], step: str = "step", initial: float = 100.0) -> DataFrame:
    """Adds what a portfolio's steps have made of ``initial``: value, n, mean, spread, win_rate, peak and drawdown so far.

    rows: the keys, ``segment``, order and step (no null). The value is the running product of 1 + step; a segment's
    product, count, sums and wins are combined first. Peaks need the values and drawdowns the peaks, so each of the two
    carries one more number per segment. Squares are about the mean of all steps of the key, so that they stay small.
    """
    within = Window.partitionBy(*keys, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(step)
    sums = {"product": F.product(1 + x), "n": F.count(x), "total": F.sum(x), "square": F.sum(x * x), "wins": F.sum(F.when(x > 0, 1).otherwise(0))}
    ends = rows.groupBy(*keys, "segment").agg(*(c.alias(name) for name, c in sums.items()))
    carry = _carry(ends, keys, {name: F.product(name) if name == "product" else F.sum(name) for name in sums})
    out = _with_carry(rows, carry, keys)
    before = lambda name, none: F.coalesce(f"{BEFORE}_{name}", F.lit(none))
    total, square = before("total", 0.0) + F.sum(x).over(within), before("square", 0.0) + F.sum(x * x).over(within)
    wins = before("wins", 0) + F.sum(F.when(x > 0, 1).otherwise(0)).over(within)
    out = out.withColumn("value", initial * before("product", 1.0) * F.product(1 + x).over(within)).withColumn("n", before("n", 0) + F.count(x).over(within))
    out = out.withColumn("_total", total).withColumn("_square", square).withColumn("_wins", wins).withColumn("mean", F.col("_total") / F.col("n")).withColumn("win_rate", F.col("_wins") / F.col("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - F.col("_total") * F.col("mean")) / (F.col("n") - 1))
    out = out.withColumn("spread", F.when(F.col("n") > 1, spread)).drop(*(f"{BEFORE}_{name}" for name in sums), "_total", "_square", "_wins")
    peaked = running(out, keys, order, "value", "peak", F.max)
    fall = F.when(F.col("peak") > 0, F.col("value") / F.col("peak") - 1).otherwise(0.0)
    return running(peaked.withColumn("_fall", fall), keys, order, "_fall", "drawdown", F.min).drop("_fall")


def running(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str, into: str, best) -> DataFrame:
    """Adds the largest (or smallest) value of a column so far."""
    within = Window.partitionBy(*keys, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "segment").agg(best(name).alias("end"))
    filled = _with_carry(rows.withColumn(into, best(name).over(within)), _carry(ends, keys, {"end": best("end")}), keys)
    chosen = F.greatest if best is F.max else F.least
    return filled.withColumn(into, chosen(into, f"{BEFORE}_end")).drop(f"{BEFORE}_end")


def _comes_first(order: tuple[tuple[str, bool], ...]):
    """A comparison of structs by (field, whether descending), with nulls where a sort of columns has them."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, down in reversed(order):
            x, y, first, later = a[name], b[name], F.lit(1 if down else -1), F.lit(-1 if down else 1)
            out = F.when(x.eqNullSafe(y), out).when(x.isNull(), first).when(y.isNull(), later).when(x < y, first).otherwise(later)
        return out

    return compare


def top_so_far(fences: DataFrame, rows: DataFrame, fence: str, time: str, order: tuple[tuple[str, bool], ...], k: int, seconds: int) -> DataFrame:
    """(fence, the columns of ``order``, rank): for each distinct fence the first k rows whose time isn't later.

    ``order`` names columns of rows and whether they descend. A segment's k first are all that later segments need of
    it: they are merged in the order of segments, and a fence meets one by one only the rows of its own segment. Nulls
    among fences and times are left out.
    """
    columns = [name for name, _ in order]
    ahead = [F.col(f"row.{name}").desc() if down else F.col(f"row.{name}") for name, down in order]
    known = rows.where(F.col(time).isNotNull()).select(F.struct(*columns).alias("row"), F.col(time).alias("_time"), span(time, seconds).alias("segment"))
    kept = known.withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy(*ahead))).where(F.col("rank") <= k).groupBy("segment").agg(F.collect_list("row").alias("kept"))  # at most k
    moments = fences.select(F.col(fence).alias("fence")).where("fence is not null").distinct().withColumn("segment", span("fence", seconds))
    past = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each segment
    every = kept.select("segment").union(moments.select("segment")).distinct().join(kept, "segment", "left")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("kept").over(past)), _comes_first(order)), 1, k)
    older = moments.join(every.select("segment", merged.alias("carried")), "segment").select("fence", F.explode("carried").alias("row"))
    own = moments.join(known, "segment").where(F.col("_time") <= F.col("fence")).select("fence", "row")
    best = F.row_number().over(Window.partitionBy("fence").orderBy(*ahead))
    return older.unionByName(own).withColumn("rank", best).where(F.col("rank") <= k).select(F.col("fence").alias(fence), "row.*", "rank")
