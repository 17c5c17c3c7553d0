"""Streams with timers give the same rows however they are cut into micro-batches."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import shadow
from tidemark.streaming import ordered, sinks

DAY = lambda d, hour=0: dt.datetime(2026, 1, d, hour)


def folder(spark, path, schema, rows, batches, seed=1):
    """Files of rows that are shuffled within about two days of each other; the last moves the watermark past all."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[-1] + dt.timedelta(hours=rng.randrange(48)))
    size = -(-len(late) // batches)
    for k in range(batches):
        spark.createDataFrame(late[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are read in the order of their times
    ordered.replay(spark.createDataFrame([], schema), path, [])
    return ordered.replayed(spark, path, spark.createDataFrame([], schema).schema)


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_running_shadow_equals_batch(spark, tmp_path, batches):
    rng, rows = random.Random(7), []
    for k in range(200):
        rows.append((rng.choice("xy"), rng.choice("ST"), rng.choice([None, -0.5, 0.25, 0.1, -0.02]), DAY(1 + k // 8, rng.randrange(24))))
    rows += [("x", "S", 0.5, DAY(3)), ("x", "S", -0.5, DAY(3)), ("x", "S", 0.5, DAY(3)), ("z", "S", 0.1, DAY(20))]
    schema = "agent_id string, symbol string, step double, ts timestamp"
    stream = folder(spark, f"{tmp_path}/in", schema, rows, batches)
    found = sinks.drain(ordered.running_shadow(stream, "3 days").where("agent_id is not null"))
    # the batch panel takes one row a date, so each step has a date of its own, in the stream's order
    ranked = spark.createDataFrame([(a, s, step, dt.date(2000, 1, 1) + dt.timedelta(i)) for i, (a, s, step, _) in enumerate(sorted(rows, key=lambda r: (r[3], r[2] or 0)))], "agent_id string, symbol string, ret double, date date")
    names = ["agent_id", "symbol", "step", "value", "roi", "rolling_return", "sharpe", "drawdown", "win_rate"]
    batch = shadow.shadow_portfolio(ranked.withColumn("signal", F.lit(1)))
    tell = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())
    assert tell(found) == tell(batch) and found.count() == len(rows)


@pytest.mark.parametrize("batches", [1, 4])
def test_shares_hold_for_their_time(spark, tmp_path, batches):
    rng = random.Random(3)
    rows = [(f"r{k:03}", rng.choice("ab"), rng.choice("cd"), rng.choice([[1, 2], [2, 1], [], None]), DAY(1 + k // 12, rng.randrange(24))) for k in range(150)]
    schema = "route_id string, source_agent_id string, target_agent_id string, memory_ids array<long>, ts timestamp"
    stream = folder(spark, f"{tmp_path}/in", schema, rows, batches)
    found = sinks.drain(ordered.first_shares(stream, "2 days", "3 days").where("source_agent_id is not null")).collect()
    until, want = {}, {}
    for route, source, target, ids, at in sorted(rows, key=lambda r: (r[4], r[0])):
        key = source, target, None if ids is None else tuple(ids)
        want[route] = key in until and until[key] > at
        if not want[route]:
            until[key] = at + dt.timedelta(days=2)
    assert {r.route_id: r.deduped for r in found} == want and len(found) == len(rows)


@pytest.mark.parametrize("batches", [1, 5])
def test_items_expire(spark, tmp_path, batches):
    rows = [(f"o{k % 3}", f"i{k}", None if k % 5 == 0 else DAY(1 + k // 4) + dt.timedelta(days=k % 5 - 1), DAY(1 + k // 4, k % 24)) for k in range(80)]
    schema = "owner string, item_id string, until timestamp, ts timestamp"
    found = sinks.drain(ordered.expiring_context(folder(spark, f"{tmp_path}/in", schema, rows, batches), "3 days").where("owner is not null"))
    events = {(r.owner, r.item_id, r.event, r["at"]) for r in found.collect()}
    assert events == {(o, i, "added", ts) for o, i, _, ts in rows} | {(o, i, "expired", until) for o, i, until, _ in rows if until}
    live = {i for _, i, event, at in events if event == "added" and at <= DAY(12)} - {i for _, i, event, at in events if event == "expired" and at <= DAY(12)}
    assert live == {i for _, i, until, ts in rows if ts <= DAY(12) and (until is None or until > DAY(12))}


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    schema = "agent_id string, symbol string, step double, ts timestamp"
    for batch in ([("a", "S", 0.1, DAY(1)), ("a", "S", 0.1, DAY(20))], [("b", "S", 0.1, DAY(21))], [("c", "S", 0.5, DAY(2)), ("b", "S", 0.1, DAY(22))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    ordered.replay(spark.createDataFrame([], schema), f"{tmp_path}/in", [])
    stream = ordered.running_shadow(ordered.replayed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "3 days")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    assert ordered.late_rows(run) == 1
    assert sorted(r.agent_id for r in spark.read.parquet(f"{tmp_path}/out").where("agent_id is not null").collect()) == ["a", "a", "b", "b"]


@pytest.mark.parametrize("per_batch", [1, 100])
def test_long_tables_in_many_files_lose_no_rows(spark, tmp_path, per_batch):
    """A replayed range may be many files, in any order of time; ranges are no longer than the delay."""
    rows = [(f"o{k % 7}", f"i{k}", DAY(1) + dt.timedelta(days=k * 17 % 50 + 3), DAY(1) + dt.timedelta(hours=(k * 5) % 960)) for k in range(240)]
    df = spark.createDataFrame(rows, "owner string, item_id string, until timestamp, ts timestamp").repartition(3, "item_id")
    ordered.replay(df, f"{tmp_path}/in", ordered.spans(df, "20 days"))
    found = sinks.drain(ordered.expiring_context(ordered.replayed(spark, f"{tmp_path}/in", df.schema, per_batch), "20 days").where("owner is not null")).collect()
    assert sorted((r.owner, r.item_id, r.event, r["at"]) for r in found) == sorted([(o, i, "added", ts) for o, i, _, ts in rows] + [(o, i, "expired", until) for o, i, until, _ in rows])
