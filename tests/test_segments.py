"""Segmented series and block products against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, memory, neighbours, portfolio, segments, shadow

START = dt.datetime(2026, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_asof_join_over_many_segments(spark):
    """One key over a hundred segments, ties, null keys and times, repeated rows, keys without a match."""
    rng = random.Random(1)
    at = lambda: START + dt.timedelta(hours=rng.randrange(2400))
    right = [("hot", at(), k, float(k)) for k in range(150)] + [(None, at(), 500 + k, 1.0) for k in range(5)] + [("late", START + dt.timedelta(days=90), 600, 2.0), ("hot", None, 700, 3.0)]
    right += [(*right[0][:2], 900, 5.0), (*right[0][:2], 901, 6.0)]
    left = [(k, rng.choice(["hot", "hot", "hot", None, "late", "none"]), at()) for k in range(200)] + [(300, "hot", None), (301, "hot", right[0][1]), (301, "hot", right[0][1])]
    a = spark.createDataFrame(left, "id long, key string, ts timestamp").repartition(3)
    b = spark.createDataFrame(right, "key string, ts timestamp, n long, found double").repartition(2)
    for seconds in (86_400, 10**9):
        joined = segments.asof_join(a, b, ("key",), "ts", "ts", seconds, ("n",))
        assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
        got = [(r.id, r.key, r.ts, r.found and r.found.n) for r in joined.collect()]
        want = []
        for k, key, ts in left:
            open_ = [(t, n) for other, t, n, _ in right if other == key and t is not None and ts is not None and t <= ts]
            want.append((k, key, ts, max(open_)[1] if open_ else None))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert segments.asof_join(a.limit(0), b, ("key",), "ts", "ts", 60).count() == 0
    assert segments.asof_join(a, b.limit(0), ("key",), "ts", "ts", 60).where("found is not null").count() == 0


def test_panel_over_years(spark):
    rng = random.Random(2)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(2000)) for _ in range(80)]
    bars = {(s, d): rng.choice([None, 1.0, 2.0, 3.0]) for s in ("hot", "rare", "one") for d in (days if s == "hot" else rng.sample(days, 4 if s == "rare" else 1))}
    panel = asof.price_panel(spark.createDataFrame([(s, d, c) for (s, d), c in bars.items()], "symbol string, date date, close double").repartition(3))
    assert "NestedLoop" not in plan_of(panel)
    want, calendar = {}, sorted({d for _, d in bars})
    for s in ("hot", "rare", "one"):
        close = day = None
        for d in calendar:
            if (s, d) in bars:
                day, close = d, bars[s, d] if bars[s, d] is not None else close
            if day is not None:
                want[s, d] = close, day
    assert {(r.symbol, r.date): (r.close, r.bar_date) for r in panel.collect()} == want


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_scan_equals_one_window(spark, days):
    """Values below zero too, long falls over segments, a null signal, one key with all but one row."""
    rng = random.Random(3)
    rows = [("hot" if k else "one", "S", dt.date(2026, 1, 1) + dt.timedelta(days=k), rng.choice([1, -1, 0]), rng.choice([None, 0.5, -0.4, 1.7, 0.01])) for k in range(120)]
    df = spark.createDataFrame(rows, "agent_id string, symbol string, date date, signal int, ret double").repartition(4)
    tell = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect())
    assert tell(shadow.shadow_portfolio(df, segment=F.floor(F.unix_date("date") / days))) == tell(shadow.shadow_portfolio(df))


def test_portfolio_segments(spark):
    rng = random.Random(4)
    rows = [(p, s, dt.date(2026, 1, 1) + dt.timedelta(days=k), rng.uniform(1, 3), rng.choice([0.0, 0.2, 0.5])) for p in ("p", None) for s in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "portfolio string, symbol string, date date, close double, weight double")
    tell = lambda x: sorted(((r.portfolio or "", r.date), [None if v is None else round(v, 6) for v in (r.equity, r.cash, r.daily_return, r.drawdown)], r.n_positions) for r in x.collect())
    assert tell(portfolio.master_portfolio(df, segment=F.floor(F.unix_date("date") / 3))) == tell(portfolio.master_portfolio(df))


def test_newest_by_segments(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, "2026-01-01", "2026-01-02", "2026-01-03"]), rng.randrange(3), rng.choice([None, *range(40)])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, event_date string, created_at int, available_at int")
    fences = spark.createDataFrame([(x,) for x in (None, -5, 0, 3, 3, 17, 39, 200)], "as_of int")
    for seconds in (1, 10, 1000):
        found = memory.newest(fences, df, 4, seconds)
        assert "NestedLoop" not in plan_of(found)
        want = set()
        for fence in (-5, 0, 3, 17, 39, 200):
            open_ = sorted((r for r in rows if r[3] is not None and r[3] <= fence), key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], -r[2], r[0]))
            want |= {(fence, r[0], i) for i, r in enumerate(open_[:4], 1)}
        assert {(r.as_of, r.id, r["rank"]) for r in found.collect()} == want


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_by_blocks(spark, monkeypatch, metric):
    """Small blocks, ties of equal vectors, zero, short, null and NaN vectors, keys and fences."""
    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)], rng.choice("ab"), rng.choice([None, 1, 2, 3])) for k in range(90)]
    rows += [(100, [0.0] * 4, "a", 1), (101, [1.0], "a", 1), (102, None, "a", 1), (103, [float("nan")] * 4, "a", 1), (104, [1.0, None], "a", 1), (105, [], "b", 2), (None, [1.0] * 4, "a", 1), rows[3]]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, sector string, available_at int").repartition(3)
    queries = df.where("id % 9 = 0 or id > 99").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), "sector", F.col("available_at").alias("as_of"))
    asked = [r for r in rows if r[0] is not None and (r[0] % 9 == 0 or r[0] > 99)]
    fine = lambda r: r[0] is not None and r[1] is not None and all(x is not None and x == x for x in r[1])

    def score(a, b):
        a, b = a + [0.0] * (4 - len(a)), b + [0.0] * (4 - len(b))
        if metric == "l2":
            return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return -sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    for same, fence in (((), None), (("sector",), ("as_of", "available_at"))):
        want = []
        for q in filter(fine, asked):
            open_ = [r for r in rows if fine(r) and (not same or r[2] == q[2]) and (not fence or (r[3] is not None and q[3] is not None and r[3] <= q[3]))]
            want += [(q[0], r[0], i) for i, r in enumerate(sorted(open_, key=lambda r: (round(score(q[1], r[1]), 9), r[0]))[:5], 1)]
        for size in (2048, 7):
            monkeypatch.setattr(neighbours, "VECTORS", size)
            monkeypatch.setattr(neighbours, "QUERIES", size)
            found = neighbours.nearest(queries, df, 5, metric, same, fence)
            assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == sorted(want)
            assert "NestedLoop" not in plan_of(found)
