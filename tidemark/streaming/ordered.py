"""Streams that must see a key's rows in the order of event time, however they are cut into micro-batches.

``InOrder`` keeps rows in map state, by slot of time, until the watermark has passed the slot; an event-time timer then
releases them sorted. What comes out therefore depends on the rows alone, as long as none is later than the watermark
allows (Spark drops those and counts them in the query's progress, ``late_rows``). State lives in RocksDB. A call of the
state costs a round trip over a socket, so running portfolios and expiring items are dealt into a fixed number of buckets
(``BUCKETS``): a bucket has one entry for a slot and one for its keys' sums, and a batch's rows of all its keys are
worked off together.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from .sinks import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups into which keys are dealt where they are many.
BUCKETS = 256
#: Later than any row: ``closing`` rows move the watermark past all others.
END = datetime(2200, 1, 1, tzinfo=UTC)


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session for streams with timers and map state, which need the RocksDB provider; the caller's own settings stay."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


class InOrder(StatefulProcessor):
    """Releases the rows of a key in the order of ``ts`` and then ``ties``, slot by slot; ``ms`` is ts in milliseconds since 1970."""

    def __init__(self, ties: tuple[str, ...], slot_ms: int):
        self.ties, self.slot = ties, slot_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot long", "rows binary")
        self.start(handle)

    def start(self, handle) -> None:
        """Makes the state of its own."""

    def release(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The result of the key's next rows, which are in order."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        for number, part in frame.groupby(frame["ms"] // self.slot):
            old = self.pending.getValue((int(number),))
            both = part if old is None else pd.concat([pickle.loads(old[0]), part])
            self.pending.updateValue((int(number),), (pickle.dumps(both),))
            if old is None:
                self.handle.registerTimer((int(number) + 1) * self.slot)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(number for (number,) in self.pending.keys() if (number + 1) * self.slot <= expiredTimerInfo.getExpiryTimeInMs())
        for number in due:
            rows = pickle.loads(self.pending.getValue((number,))[0])
            self.pending.removeKey((number,))
            yield self.release(key, rows.sort_values(["ts", *self.ties], kind="stable"))

    def close(self) -> None:
        pass


def carried(values: pd.Series, groups: pd.Series, what: str) -> np.ndarray:
    """The running product, sum, maximum or minimum of each group's rows."""
    return getattr(values.groupby(groups, sort=False), what)().to_numpy()


class Shadow(InOrder):
    """Values and expanding metrics of a bucket's shadow portfolios after each of their steps."""

    def __init__(self, initial: float, slot_ms: int):
        super().__init__(("step",), slot_ms)
        self.initial = initial

    def start(self, handle) -> None:
        self.sums = handle.getValueState("sums", "portfolios binary")

    def release(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["agent_id", "symbol"]
        known = self.sums.get()
        before = pickle.loads(known[0]) if known else pd.DataFrame({"agent_id": [], "symbol": [], "value": [], "peak": [], "fall": [], "n": [], "base": [], "total": [], "squares": [], "wins": []}).astype({c: object for c in names})
        rows = rows.reset_index(drop=True)
        own = rows[[*names, "step"]].merge(before, "left", names)  # null names are equal
        group = own.groupby(names, dropna=False, sort=False).ngroup()
        step = own["step"]
        first = step.groupby(group).transform("first")
        start = {c: own[c].fillna(x) for c, x in {"value": self.initial, "peak": -np.inf, "fall": np.inf, "n": 0, "base": first, "total": 0.0, "squares": 0.0, "wins": 0}.items()}
        values = start["value"].to_numpy() * carried(1 + step, group, "cumprod")
        peaks = np.maximum(carried(pd.Series(values), group, "cummax"), start["peak"].to_numpy())
        falls = np.where(peaks > 0, values / np.where(peaks > 0, peaks, 1.0) - 1, 0.0)
        falls = np.minimum(carried(pd.Series(falls), group, "cummin"), start["fall"].to_numpy())
        count = group.groupby(group).cumcount().to_numpy() + 1 + start["n"].to_numpy().astype(np.int64)
        base = start["base"].to_numpy()
        off = step - base
        totals = start["total"].to_numpy() + carried(off, group, "cumsum")
        square = start["squares"].to_numpy() + carried(off**2, group, "cumsum")
        won = start["wins"].to_numpy().astype(np.int64) + carried((step > 0).astype(np.int64), group, "cumsum")
        spread = np.sqrt(np.maximum(square - totals**2 / count, 0) / np.maximum(count - 1, 1))
        sharpe = np.where((count < 2) | (spread <= 1e-12), 0.0, (base + totals / count) / np.where(spread > 0, spread, 1.0))
        now = own[names].assign(value=values, peak=peaks, fall=falls, n=count, base=base, total=totals, squares=square, wins=won)
        kept = pd.concat([before, now[~group.duplicated(keep="last")]]) if len(before) else now[~group.duplicated(keep="last")]
        self.sums.update((pickle.dumps(kept.drop_duplicates(names, keep="last")),))
        change = values / self.initial - 1
        return own[names].assign(ts=rows["ts"], step=step, n=count, value=values, roi=change, rolling_return=change, sharpe=sharpe, drawdown=falls, win_rate=won / count)


SHADOW = "agent_id string, symbol string, ts timestamp, step double, n long, value double, roi double, rolling_return double, sharpe double, drawdown double, win_rate double"


def milliseconds(delay: str) -> int:
    return int(pd.Timedelta(delay) / pd.Timedelta("1ms"))


def timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.where("ts is not null").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)


def dealt(rows: DataFrame, *keys: str):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("bucket")


def running_shadow(steps: DataFrame, delay: str = "10 days", initial: float = 100.0) -> DataFrame:
    """Running shadow portfolios of a stream (agent_id, symbol, ts, step): after each step what the batch panel has.

    Steps of one time go by size, a null step is 0. Rows may come in any order within ``delay`` of the newest; each comes
    out once the watermark has passed its slot of that length. Rows with a null time never come out: they have no place.
    """
    steps = steps.withColumn("step", F.coalesce(F.col("step").cast("double"), F.lit(0.0)))
    return dealt(timed(steps, delay), "agent_id", "symbol").transformWithStateInPandas(Shadow(initial, milliseconds(delay)), SHADOW, "append", "eventTime")


class FirstShares(InOrder):
    """Marks what has been shared along a route before, within a time to live."""

    def __init__(self, ttl_ms: int, slot_ms: int):
        super().__init__(("route_id",), slot_ms)
        self.ttl = ttl_ms

    def start(self, handle) -> None:
        self.seen = handle.getMapState("seen", "memory_ids string", "until long")

    def release(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["memory_ids"].tolist()
        known = {x: until[0] for x in set(ids) if (until := self.seen.getValue((x,)))}
        marks = []
        for memory_ids, at in zip(ids, rows["ms"].tolist(), strict=True):
            marks.append(known.get(memory_ids, -1) > at)
            if not marks[-1]:
                known[memory_ids] = at + self.ttl
        for memory_ids in set(ids):
            self.seen.updateValue((memory_ids,), (known[memory_ids],))
            self.handle.registerTimer((known[memory_ids] // self.slot + 1) * self.slot)
        return pd.DataFrame({"route_id": rows["route_id"].to_numpy(), "source_agent_id": key[0], "target_agent_id": key[1], "ts": rows["ts"].to_numpy(), "deduped": marks})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        now = expiredTimerInfo.getExpiryTimeInMs()
        for memory_ids in [x for (x,), (until,) in self.seen.iterator() if until < now]:
            self.seen.removeKey((memory_ids,))


SHARES = "route_id string, source_agent_id string, target_agent_id string, ts timestamp, deduped boolean"


def first_shares(routes: DataFrame, ttl: str, delay: str = "10 days") -> DataFrame:
    """Marks routes of a stream (route_id, source_agent_id, target_agent_id, memory_ids, ts) that share again what is still known.

    A share is the ordered list ``memory_ids`` between two agents. The first one holds for ``ttl``; repeats before its
    end are ``deduped`` and don't prolong it. Routes of one time go by route_id. Rows may come in any order within
    ``delay``. What has ended is dropped from the state.
    """
    joined = F.to_json("memory_ids").alias("memory_ids")
    rows = routes.select("route_id", "source_agent_id", "target_agent_id", joined, "ts")
    return timed(rows, delay).groupBy("source_agent_id", "target_agent_id").transformWithStateInPandas(FirstShares(milliseconds(ttl), milliseconds(delay)), SHARES, "append", "eventTime")


class Expiry(StatefulProcessor):
    """Tells when an item is added and when its time to live has passed; an item without an end has no state."""

    def __init__(self, slot_ms: int):
        self.slot = slot_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "slot long", "items binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        ending = frame.loc[frame["until"].notna(), ["owner", "item_id", "until"]].drop_duplicates()
        for number, part in ending.groupby(ending["until"].astype("int64") // self.slot):
            old = self.items.getValue((int(number),))
            both = part if old is None else pd.concat([pickle.loads(old[0]), part]).drop_duplicates()
            self.items.updateValue((int(number),), (pickle.dumps(both),))
            if old is None:
                self.handle.registerTimer((int(number) + 1) * self.slot)
        yield self.events(frame, "added", "ms")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(number for (number,) in self.items.keys() if (number + 1) * self.slot <= expiredTimerInfo.getExpiryTimeInMs())
        for number in due:
            items = pickle.loads(self.items.getValue((number,))[0])
            self.items.removeKey((number,))
            yield self.events(items, "expired", "until")

    def events(self, items: pd.DataFrame, event: str, ms: str) -> pd.DataFrame:
        return pd.DataFrame({"owner": items["owner"], "item_id": items["item_id"], "event": event, "ms": items[ms].astype("int64")})

    def close(self) -> None:
        pass


def expiring_context(items: DataFrame, delay: str = "10 days", slot: str = "1 day") -> DataFrame:
    """Events ``added`` (at ts) and ``expired`` (at until) of shared items: a stream (owner, item_id, ts, until).

    An item with a null ``until`` never expires, and one with a null ts doesn't come in. An item that comes when its time
    has passed is added, and expires at once. Repeats of an item and end expire once. Times are whole milliseconds. Ends
    are told once the watermark has passed their ``slot``.
    """
    rows = timed(items, delay).withColumn("until", F.unix_millis("until"))
    events = dealt(rows, "owner").transformWithStateInPandas(Expiry(milliseconds(slot)), "owner string, item_id string, event string, ms long", "append", "eventTime")
    return events.select("owner", "item_id", "event", F.timestamp_millis("ms").alias("at"))


def replay(rows: DataFrame, path: str, cuts: list) -> None:
    """Writes a table as a folder that a stream reads in the order of ``ts``: a job for each range between two ``cuts``, and a closing row last.

    A range may be many files, which a stream meets in any order; so a range must not be longer than the stream's delay
    (``spans``). The closing row has only the time ``END``; it moves the watermark past all others, and what comes of it
    must be left out.
    """
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows if low is None else rows.where(F.col("ts") >= F.lit(low))
        part = part if high is None else part.where(F.col("ts") < F.lit(high))
        part.write.mode("append").parquet(path)
    closing = rows.sparkSession.createDataFrame([(END,)], "ts timestamp").select(*(F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    closing.write.mode("append").parquet(path)


def spans(rows: DataFrame, delay: str) -> list[datetime]:
    """Cuts of a table's times into ranges no longer than ``delay``; ranges without rows are left out."""
    width = milliseconds(delay)
    number = F.floor(F.unix_millis("ts") / width)
    found = sorted(r[0] for r in rows.where("ts is not null").select(number).distinct().collect())  # one for each range
    return [datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=n * width) for n in found[1:]]


def replayed(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """A folder of ``replay`` as a stream in a session for state; at most so many files a micro-batch, the oldest first.

    Files of two ranges may come in one batch.
    """
    return stateful_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def late_rows(run) -> int:
    """Rows that a run of a stream has dropped behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])


def stream_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
