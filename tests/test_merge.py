"""Stored tables after merges, and memories over days that are cut off."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import memory
from tidemark.sources import merge

SCHEMA = "symbol string, date date, close double, seq int"


def rows(spark, *given):
    return spark.createDataFrame([(s, dt.date(2026, 1, d), c, q) for s, d, c, q in given], SCHEMA)


def files(path):
    return {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns for folder, _, names in os.walk(path) for name in names if name.startswith("part-")}


def test_merges_touch_their_partitions_only(spark, tmp_path):
    path, day = f"{tmp_path}/store", F.date_format("date", "yyyy-MM-dd")
    merge.merge_into(path, rows(spark, *((s, d, 1.0, 0) for s in "abc" for d in range(1, 9))), ("symbol", "date"), "load", day)
    before = files(path)
    batch = rows(spark, ("a", 2, 5.0, 1), ("a", 2, 6.0, 2), ("z", 2, 7.0, 0), ("b", 20, 8.0, 0))
    merge.merge_into(path, batch, ("symbol", "date"), "second", day, "seq")
    after = files(path)
    kept = {f for f in before if "part=2026-01-02" not in f}
    assert kept <= set(after) and all(after[f] == before[f] for f in kept)
    assert {f.split("part=")[1][:10] for f in set(after) - set(before)} == {"2026-01-02", "2026-01-20"}
    want = {(s, d): 1.0 for s in "abc" for d in range(1, 9)} | {("a", 2): 6.0, ("z", 2): 7.0, ("b", 20): 8.0}
    tell = lambda: {(r.symbol, r.date.day): r.close for r in merge.stored(spark, path, batch.schema).collect()}
    assert tell() == want and merge.stored(spark, path, batch.schema).count() == len(want)
    merge.merge_into(path, batch.limit(0), ("symbol", "date"), "none", day, "seq")
    merge.merge_into(path, rows(spark, ("a", 1, 99.0, 0)), ("symbol", "date"), "second", day, "seq")  # that batch has ended
    assert tell() == want


def test_a_merge_goes_on_from_what_it_staged(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    load = spark.createDataFrame([(f"n{k}" if k else None, k) for k in range(40)], "event_id string, v int")
    merge.merge_into(path, load, ("event_id",), "load")

    def lost(df, at):  # staged, then the driver goes before the partitions are replaced
        df.write.mode("overwrite").parquet(at)
        raise RuntimeError("lost")

    monkeypatch.setattr(merge, "written", lost)
    batch = spark.createDataFrame([("n3", 300), (None, 400), ("new", 1)], "event_id string, v int")
    with pytest.raises(RuntimeError):
        merge.merge_into(path, batch, ("event_id",), "b")
    monkeypatch.undo()
    merge.merge_into(path, batch, ("event_id",), "b")
    found = {r.event_id: r.v for r in merge.stored(spark, path, batch.schema).collect()}
    assert found == {f"n{k}" if k else None: k for k in range(40)} | {"n3": 300, None: 400, "new": 1}


@pytest.mark.parametrize("legacy", [False, True])
def test_days_go_on(spark, tmp_path, legacy):
    state = memory.insert(spark.createDataFrame([(k, "S", ("short", "mid", "long")[k % 3]) for k in range(30)], "id long, symbol string, layer string")).withColumn("importance", (F.col("id") * 4).cast("double"))
    given = lambda d: spark.createDataFrame([(k, 1 if (k + d) % 3 else -1, k) for k in range(0, 30, 2)], "id long, value int, seq long")
    new = lambda d: spark.createDataFrame([(100 * d + k, "S", "short") for k in range(3)], "id long, symbol string, layer string")
    days = [(f"2026-01-0{d}", new(d), given(d)) for d in (1, 2, 3)]
    tell = lambda df: sorted(tuple(r) for r in df.collect())
    memory.run_days(f"{tmp_path}/cut", state, days[:1], legacy)
    whole, cut = memory.run_days(f"{tmp_path}/whole", state, days, legacy), memory.run_days(f"{tmp_path}/cut", state, days, legacy)
    assert tell(whole) == tell(cut)
    gone = [r["id"] for d in ("01", "02", "03") for r in spark.read.parquet(f"{tmp_path}/cut/day=2026-01-{d}/removed").collect()]
    there = {r["id"] for r in whole.collect()}
    assert gone and (set(gone) & there if legacy else not set(gone) & there)
    plain = memory.run_days(f"{tmp_path}/whole", state, days[:1], legacy)  # a day's own state stays
    assert {r["id"] for r in plain.collect()} >= {100, 101, 102}
