"""Near duplicates over spans of time, and the whole cleaning job, against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import text as T
from tidemark.operators import news
from tidemark.plans.views import view


def lcs(a, b):
    row, other = np.zeros(len(b) + 1, np.int32), np.array([*map(ord, b)], np.int64)
    for c in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == ord(c))))
    return int(row[-1])


def near(a, b, ratio):
    return bool(a and b) and 2 * min(len(a), len(b)) > ratio * (len(a) + len(b)) and 2 * lcs(a, b) / (len(a) + len(b)) > ratio


def without_near_previous(rows, key, column, ratio):
    """rows: dicts with published_at and event_id."""
    last, kept = {}, []
    for r in sorted(rows, key=lambda r: (r["published_at"], r["event_id"])):
        if not near(r[column], last.get(r[key]), ratio):
            kept.append(r)
        last[r[key]] = r[column]
    return kept


def test_common_length():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(0, 200))) for _ in range(2))
        true = lcs(a, b)
        assert news.common_length(a, b) == true
        for least in (true - 1, true, true + 1, 60):
            assert news.common_length(a, b, least) == true if least <= true else news.common_length(a, b, least) < least


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_near_previous_over_spans(spark, seconds):
    """Hot keys over many spans, ties of time, null and empty texts, null keys, repeated rows; other columns stay."""
    rng = random.Random(2)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(60)) for _ in range(3)]

    def text():
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 3, 25])):
            base[rng.randrange(60)] = rng.choice("xyz")
        return rng.choice([None, "", "".join(base), "".join(base), "".join(base)[:45]])

    rows = [(f"e{k:03}", rng.choice(["hot", "hot", "hot", "b", None]), dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(60)), text(), "extra") for k in range(160)]
    df = spark.createDataFrame(rows, "event_id string, symbol string, published_at timestamp, text string, segment string").repartition(3)
    for ratio in (0.3, 0.6, 0.9):
        found = news.drop_near_previous(df, "text", ratio, seconds=seconds)
        assert found.columns == df.columns
        want = without_near_previous([r.asDict() for r in df.collect()], "symbol", "text", ratio)
        assert sorted(r.event_id for r in found.collect()) == sorted(r["event_id"] for r in want)


def test_counts_bound_what_is_common(spark):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abz é\n") for _ in range(rng.randrange(30))) for _ in range(2)) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("most", news.common_at_most(news.character_counts(F.col("a")), news.character_counts(F.col("b")))).collect():
        assert lcs(r.a, r.b) <= r.most <= min(len(r.a), len(r.b))


def first_of(rows, key, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(key(r), r)
    return list(out.values())


def test_clean_job_by_brute_force(spark):
    """What each column becomes is the functions' own business; which rows stay and their dates are done anew here."""
    items = view(spark, DATA, "news")
    body = T.trim_dateline(F.col("text"))
    told = items.withColumns({"norm": T.without_update(F.col("headline")), "no": T.update_number(F.col("headline")), "body": T.without_spaces(body), "head": T.without_spaces(F.col("headline")), "clean": T.clean_text(body)})
    rows = [r.asDict() for r in told.collect()]
    newest = lambda r: (-r["published_at"].timestamp(), r["event_id"])
    rows = first_of(rows, lambda r: (r["symbol"], r["norm"]), lambda r: (-(r["no"] if r["no"] is not None else -1), *newest(r)))
    rows = first_of(rows, lambda r: (r["symbol"], r["body"]), newest)
    rows = first_of(rows, lambda r: (r["symbol"], r["head"]), newest)
    again = {r.body: r.clean for r in spark.createDataFrame([(r["clean"],) for r in rows], "body string").distinct().select("body", T.clean_text(F.col("body")).alias("clean")).collect()}
    assert all(k == v for k, v in again.items())  # cleaning twice is cleaning once
    rows = first_of(rows, lambda r: (r["symbol"], r["clean"]), lambda r: (r["published_at"], r["event_id"]))
    rows = without_near_previous(without_near_previous(rows, "symbol", "clean", 0.6), "symbol", "headline", 0.9)
    calendar = sorted(r.date for r in view(spark, DATA, "bars").select("date").distinct().collect())
    want = set()
    for r in rows:
        date = r["published_at"].date() + dt.timedelta(days=r["published_at"].hour >= 16)
        want.add((r["event_id"], r["symbol"], date, next((d for d in calendar if d >= date), None)))
    found = plans.queries()["news_clean_pipeline"](spark, DATA).collect()
    assert {(r.event_id, r.symbol, r.date, r.trading_date) for r in found} == want and len(found) == len(want)


def test_texts_are_compared_once(spark):
    """What the headlines' pass reads is a table, so neither of its two branches compares the texts anew."""
    plan = news.drop_near_duplicates(view(spark, DATA, "news"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_near_duplicates_of_odd_rows(spark):
    """By text and then by headline: hot and null keys, ties of time, null and empty texts; all columns stay."""
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(80)) for _ in range(3)]
    odd = lambda: rng.choice([None, "", *("".join(rng.choice("xyz") if rng.random() < 0.2 else c for c in rng.choice(bases)) for _ in range(6))])
    rows = [(f"e{k:03}", rng.choice(["hot", "hot", "b", None]), dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(2000)), odd(), rng.choice(bases)[: rng.randrange(70, 80)], "extra") for k in range(160)]
    df = spark.createDataFrame(rows, "event_id string, symbol string, published_at timestamp, text string, headline string, segment string").repartition(3)
    found = news.drop_near_duplicates(df)
    rows = [r.asDict() for r in df.collect()]
    want = without_near_previous(without_near_previous(rows, "symbol", "text", 0.6), "symbol", "headline", 0.9)
    assert found.columns == df.columns and 0 < len(want) < len(rows)
    assert sorted(map(str, (r.asDict() for r in found.collect()))) == sorted(map(str, want))


def test_passes_go_without_texts(spark, monkeypatch):
    """No pass of the cleaning job sorts or shuffles rows with their texts."""
    passed = []
    for place, name in ((news, "distinct_on"), (news.segments, "previous")):
        plain = getattr(place, name)
        monkeypatch.setattr(place, name, lambda df, *rest, plain=plain: passed.append(df.columns) or plain(df, *rest))
    job = news.clean_job(view(spark, DATA, "news"), view(spark, DATA, "bars").select("date").distinct())
    assert len(passed) == 6 and not any("text" in columns for columns in passed)
    assert "SortMergeJoin" in job.select("text")._jdf.queryExecution().executedPlan().toString()  # texts aren't broadcast
