"""Literal cases of single operators, and properties that must hold."""

import datetime as dt
import math

import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark.functions import decisions, text
from tidemark.operators import asof, classifier, evaluate, graph, memory, neighbours, news, portfolio, returns, rules, shadow
from tidemark.plans import storage
from tidemark.sources import event_log, store, tables
from tidemark.streaming import feeds

D1, D2, D3 = dt.date(2026, 1, 2), dt.date(2026, 1, 3), dt.date(2026, 1, 4)


def test_returns(spark):
    row = spark.createDataFrame([(100.0, 105.0), (0.0, 1.0), (None, 1.0)], "a double, b double").select(returns.simple_return(F.col("a"), F.col("b")), returns.log_return(F.col("a"), F.col("b"))).collect()
    assert row[0][0] == pytest.approx(0.05) and row[0][1] == pytest.approx(0.04879016416943205)
    assert row[1][0] is None and row[2][1] is None


def test_label(spark):
    got = spark.createDataFrame([(0.05,), (-0.05,), (0.0,), (None,)], "r double").select(returns.label(F.col("r"), 0.01)).collect()
    assert [x[0] for x in got] == [1, -1, 0, None]


def test_panel_carries_stale_bars(spark):
    bars = spark.createDataFrame([("A", D1, 1.0), ("A", D3, 3.0), ("B", D2, 5.0)], "symbol string, date date, close double")
    got = {(r.symbol, r.date): (r.close, r.bar_date) for r in asof.price_panel(bars).collect()}
    assert got[("A", D2)] == (1.0, D1) and got[("B", D3)] == (5.0, D2) and ("B", D1) not in got


def test_no_leakage(spark):
    """What is known until a date doesn't change when later rows come."""
    bars = spark.createDataFrame([("A", D1, 1.0), ("A", D2, 2.0)], "symbol string, date date, close double")
    feed = spark.createDataFrame([("A", dt.datetime(2026, 1, 2, 9)), ("A", dt.datetime(2026, 1, 3, 9))], "symbol string, available_at timestamp_ntz")
    early = asof.counts_so_far(asof.price_panel(bars), feed, "n").where(F.col("date") <= D2).collect()
    more = bars.union(spark.createDataFrame([("A", D3, 9.0)], bars.schema))
    later = feed.union(spark.createDataFrame([("A", dt.datetime(2026, 1, 4, 9))], feed.schema))
    assert sorted(early) == sorted(asof.counts_so_far(asof.price_panel(more), later, "n").where(F.col("date") <= D2).collect())
    fenced = store.fenced(later.withColumn("id", F.lit(1)), "2026-01-03 00:00:00", "id").count()
    assert fenced == 1


def test_shadow_literal(spark):
    rows = spark.createDataFrame([("a", "S", D1, 1, 0.1), ("a", "S", D2, 1, -0.2)], "agent_id string, symbol string, date date, signal int, ret double")
    last = {r.date: r for r in shadow.shadow_portfolio(rows).collect()}
    assert last[D1].value == pytest.approx(110) and last[D2].value == pytest.approx(88)
    assert last[D2].roi == pytest.approx(-0.12) and last[D2].drawdown == pytest.approx(-0.2) and last[D2].win_rate == 0.5


def test_risk_rules_literal(spark):
    rows = spark.createDataFrame([(1, "A", 2.0), (1, "B", -1.0), (1, "C", float("nan"))], "k int, symbol string, weight double")
    got = {r.symbol: (r.weight, r.cash_weight) for r in portfolio.risk_rules(rows, 0.4, "k").collect()}
    assert got["A"] == pytest.approx((0.4, 0.6)) and got["B"][0] == got["C"][0] == 0


def test_trades_literal(spark):
    weights = spark.createDataFrame([("A", 0.4, 100.0)], "symbol string, weight double, price double")
    none = spark.createDataFrame([], "symbol string, shares double")
    assert portfolio.target_trades(weights, none, 100_000.0).first().trade == pytest.approx(400)
    with pytest.raises(Exception, match="positive"):
        portfolio.target_trades(weights.withColumn("price", F.lit(0.0)), none, 1.0).collect()


def test_weights_and_cash_sum_to_one(spark):
    rows = spark.createDataFrame([(d, s, (d + s) % 3 - 1) for d in range(5) for s in range(7)], "date int, symbol int, action_signal int")
    got = portfolio.target_weights(rows, 0.3, "date").groupBy("date").agg((F.sum("weight") + F.first("cash_weight")).alias("all")).collect()
    assert all(r["all"] == pytest.approx(1) for r in got)


def test_master_portfolio_costs_match_without_cost(spark):
    rows = spark.createDataFrame([("p", d, s, 10.0 + i * j, 0.3) for i, d in enumerate((D1, D2, D3)) for j, s in enumerate("AB")], "portfolio string, date date, symbol string, close double, weight double")
    free, costly = portfolio.master_portfolio(rows), portfolio.master_portfolio_cost(rows, 0.0)
    assert [(r.date, pytest.approx(r.equity)) for r in free.orderBy("date").collect()] == [(r.date, r.equity) for r in costly.orderBy("date").collect()]


def test_correlation_of_perfect_lines(spark):
    rows = spark.createDataFrame([(s, d, x * k) for s, k in (("A", 1.0), ("B", 2.0), ("C", -1.0), ("D", 0.0)) for d, x in ((D1, 0.1), (D2, 0.3), (D3, -0.2))], "symbol string, date date, ret double")
    got = {(r.target, r.source): r.weight for r in graph.correlation_edges(rows).collect()}
    assert got[("A", "B")] == pytest.approx(1) and got[("C", "A")] == pytest.approx(-1) and got[("A", "D")] == 0 and got[("A", "A")] == 1
    sums = graph.attention(graph.correlation_edges(rows)).groupBy("target").agg(F.sum("attention").alias("s")).collect()
    assert all(r.s == pytest.approx(1) or r.s == 0 for r in sums)


def test_text_norm_literal(spark):
    assert graph.text_norms(spark.createDataFrame([("A", [3.0, 4.0])], "symbol string, embedding array<float>")).first().text_norm == pytest.approx(5)


def test_verdict_literals(spark):
    rows = spark.createDataFrame([("buy", -1, 0.42), ("buy", -1, 0.9), ("hold", 0, 0.2), ("hold", 0, 0.9)], "decision string, graph_signal int, fusion_score double")
    assert [r.verdict for r in rules.judged(rows).collect()] == ["reduce", "override_hold", "override_sell", "keep"]


def test_decisions(spark):
    got = spark.createDataFrame([(" BUY",), ("x",), (None,)], "d string").select(decisions.decision_signal(F.col("d")), decisions.normal_decision(F.col("d")), decisions.is_valid_decision(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1, "buy", True), (0, "hold", False), (0, "hold", False)]


def test_wilcoxon_small(spark):
    curves = [("m1", d, 1.0 * i) for i, d in enumerate((D1, D2, D3))] + [("m2", d, 0.0) for d in (D1, D2, D3)]
    rows = spark.createDataFrame([(m, "S", d, v) for m, d, v in curves], "model string, symbol string, date date, cumulative double")
    got = evaluate.wilcoxon_pairs(rows).first()
    assert (got.n, got.w) == (2, 0.0)


def test_erfc(spark):
    got = spark.range(1).select(*(evaluate.erfc(F.lit(x)) for x in (0.0, 0.5, 1.5))).first()
    assert list(got) == pytest.approx([math.erfc(x) for x in (0.0, 0.5, 1.5)], abs=1e-6)


def test_indel_ratio():
    assert news.common_length("kitten", "sitting") == 4
    assert 2 * news.common_length("abcd", "abcd") / 8 == 1


def test_clean_text(spark):
    got = spark.createDataFrame([("Éa\nsee HTTP://x.y/z or a@b.co, +1 (555) 123-4567!",)], "t string").select(text.clean_text(F.col("t"))).first()[0]
    assert got == "ea see <url> or <email>, <phone>!"


def test_memory_jump_resets(spark):
    rows = spark.createDataFrame([(1, "short", 85.0, 0.2, 3), (2, "mid", 50.0, 0.5, 2), (3, "long", 70.0, 0.5, 2), (4, "reflection", 99.0, 0.5, 2)], "id long, layer string, importance double, recency double, delta long")
    got = {r.id: (r.layer, r.recency, r.delta) for r in memory.jump(rows).collect()}
    assert got == {1: ("long", 1.0, 0), 2: ("short", 0.5, 2), 3: ("mid", 0.5, 2), 4: ("reflection", 0.5, 2)}


def test_memory_feedback_closed_form(spark):
    rows = spark.createDataFrame([(1, 10.0, 1.0, 1.1, 2)], "id long, importance double, recency double, compound double, access_counter long")
    given = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, -1, 3)], "id long, value int, seq int")
    gone = spark.createDataFrame([], "id long")
    got = memory.feedback(rows, given, gone).first()
    assert (got.access_counter, got.importance) == (3, 10 + 5 * (3 + 4 + 3))


def test_prefiltered_search_answers_every_block(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, embedding array<float>")
    metadata = vectors.select("id", F.when(F.col("id") % 2 == 0, D1).otherwise(D3).alias("available_at"))
    queries = vectors.where("id % 6 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.when(F.col("id") % 4 == 0, D1).otherwise(D3).alias("as_of"))
    whole = sorted(memory.search_as_of(queries, vectors, metadata, 4, prefilter=True).collect())
    assert len(whole) == 40 and all(r["id"] % 2 == 0 for r in whole if r["query_id"] % 4 == 0)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    assert sorted(memory.search_as_of(queries, vectors, metadata, 4, prefilter=True).collect()) == whole


def test_search_or_newest(spark, monkeypatch):
    """A query whose nearest have no metadata gets the newest open records; one whose nearest are all behind the fence gets nothing."""
    vectors = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(8)] + [(20, [-1.0, 0.0]), (21, [-1.0, 0.1])], "id long, embedding array<double>")
    metadata = spark.createDataFrame([(20, "2024-01-03", 3, 3), (21, "2024-01-02", 2, 9), (50, "2024-01-02", 1, 1), (51, "2024-01-02", 2, 2), (52, "2024-01-01", 7, 4)], "id long, event_date string, created_at int, available_at int")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [1.0, 0.0], 4), (3, [-1.0, 0.0], 3), (4, [-1.0, 0.0], 2), (5, [1.0, 0.0], 0)], "query_id long, query array<double>, as_of int")
    expected = {(1, 51, 1), (2, 20, 1), (3, 20, 1)}
    for seconds in (86_400, 1):
        monkeypatch.setattr(memory.newest, "__defaults__", (seconds,))
        found = memory.search_or_newest(queries, vectors, metadata, 1).collect()
        assert {(r.query_id, r.id, r.rank) for r in found} == expected
        assert {r.query_id for r in found if r.score is None} == {1, 2}


def test_references(spark):
    found = spark.createDataFrame([("A", "short", 1), ("A", "mid", -1), ("B", "short", 2)], "symbol string, layer string, id long")
    texts = spark.createDataFrame([(1, "é" * 200), (2, None), (-1, "none")], "id long, text string")
    agents = spark.createDataFrame([("x", "A", "2024-01-01"), ("y", "A", "2024-01-02"), ("z", "C", "2024-01-02")], "agent_id string, symbol string, date string")
    assert sorted(tuple(r) for r in memory.references(found, texts, agents).collect()) == [(1, "short", "A", "2024-01-01", "x", "é" * 160), (1, "short", "A", "2024-01-02", "y", "é" * 160)]


def test_quotes_are_data(spark):
    bars = spark.createDataFrame([("BRK'B;DROP", D1), ("A", D1)], "symbol string, date date")
    asked = spark.createDataFrame([("BRK'B;DROP",)], "symbol string")
    assert store.for_symbols(bars, asked).count() == 1


def test_missing_columns_and_files(spark, tmp_path):
    with pytest.raises(ValueError, match="close"):
        tables.prices(spark.createDataFrame([("A", "2026-01-02")], "symbol string, date string"))
    with pytest.raises(ValueError, match="published_at"):
        tables.news(spark.createDataFrame([("A", "t")], "symbol string, text string"))
    found = tables.market_tables(spark, str(tmp_path))
    assert all(df.isEmpty() for df in found.values()) and "event_id" in found["news"].columns


def test_csv_and_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 'say "hi",\nplease', 1.5)], "symbol string, text string, x double")
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", "symbol string, text string, x double").collect() == df.collect()
    tables.write_feed(df, f"{tmp_path}/p", ("symbol",))
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
    store.snapshot(df, f"{tmp_path}/s", "2026-01-02")
    assert store.restore(spark, f"{tmp_path}/s", "2026-01-02").count() == 1


def test_csv_by_key_has_bounded_files(spark, tmp_path):
    """Files don't grow with keys, odd keys stay as they are, and one key's rows are read from its bucket."""
    odd = [None, " A", "A ", "A", 'say "hi",\nplease', "a/b=c", "__HIVE_DEFAULT_PARTITION__"]
    df = spark.createDataFrame([(f"K{k % 600}", k) for k in range(1200)] + [(key, -k) for k, key in enumerate(odd)], "symbol string, n int")
    tables.write_csv_by_key(df.repartition(4), f"{tmp_path}/k", "symbol")
    found = tables.read_csv_by_key(spark, f"{tmp_path}/k", "symbol string, n int", "symbol")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert len(list(tmp_path.rglob("part-*"))) <= tables.BUCKETS
    for key in odd[1:] + ["K7"]:
        assert sorted(tables.read_csv_by_key(spark, f"{tmp_path}/k", "symbol string, n int", "symbol", key).collect()) == sorted(df.where(F.col("symbol") == key).collect())


def test_export_has_bounded_files(spark, tmp_path, monkeypatch):
    """More symbols than buckets, each read again."""
    events = [(k, dt.datetime(2026, 1, 1 + k % 3), k % 500, "view", 1.0) for k in range(1000)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"{tmp_path}/shared")
    found = storage.export_actions(spark, str(tmp_path))
    assert found.select("symbol").distinct().count() == 500
    assert len(found.inputFiles()) <= 256


def test_event_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "S", D1, None), ("b", "S", D2, 1.0)], "agent_id string, symbol string, date date, v double")
    event_log.append(event_log.artifacts(rows, "kind", "date", "agent_id", "symbol", "v"), f"{tmp_path}/log")
    event_log.append(event_log.artifacts(rows, "other", "date", "agent_id"), f"{tmp_path}/log")
    lines = event_log.read(spark, f"{tmp_path}/log", "kind", "2026-01-03")
    assert [(r.agent_id, r.v) for r in event_log.typed(lines, "agent_id string, symbol string, v double").collect()] == [("b", 1.0)]


def test_calendar_gaps(spark):
    calendar = spark.createDataFrame([(D1,), (D3,)], "date date")
    days = spark.createDataFrame([(D2,), (dt.date(2026, 2, 1),)], "date date")
    got = {r.date: r.trading_date for r in asof.next_trading_day(days, calendar).collect()}
    assert got == {D2: D3, dt.date(2026, 2, 1): None}
    assert asof.outside_calendar(days, calendar).count() == 2


def test_dataset_dimension_is_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, h_text array<double>")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id int, label int")
    with pytest.raises(Exception, match="dimension"):
        classifier.dataset(rows, labels, ("id",)).collect()


def test_classifier_learns_and_saves(spark, tmp_path):
    rows = spark.createDataFrame([([x, y], int(x > y)) for x in (0.0, 1.0, 2.0) for y in (0.5, 1.5)], "x array<double>, y int")
    model = classifier.train(rows)
    w, b = classifier.weights(model)
    scored = rows.withColumn("score", classifier.score(F.col("x"), w, b)).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    assert classifier.evaluate(scored).first().accuracy >= 0.75
    model.write().overwrite().save(f"{tmp_path}/m")
    again = type(model).load(f"{tmp_path}/m")
    assert classifier.weights(again)[0] == pytest.approx(w)
    both = classifier.predictions(again, rows).select("score").collect()
    assert [r.score for r in both] == pytest.approx([r.score for r in scored.collect()], abs=1e-6)


def test_user_function_hook(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    assert classifier.with_function(df, "text", "n", "long", lambda s: s.str.len()).first().n == 3


def test_event_log_has_bars_of_every_day(spark):
    from tidemark import plans
    from tidemark.plans.views import view

    found = {str(r["date"]): (r["n"], r["ids"]) for r in plans.queries()["event_log_write"](spark, DATA).where("artifact_type = 'price_bar'").collect()}
    bars = {str(r["date"]): (r["count"], r["count"]) for r in view(spark, DATA, "bars").groupBy("date").count().collect()}
    assert found == bars and max(bars) > "2024-01-05"


def test_context_feed_over_batches(spark, tmp_path):
    """Items keep their own time to live; a feed that is started again with its checkpoint adds only what is new."""
    schema = "item_id long, created_at date, ttl_days int"
    rows = [(i, dt.date(2026, 1, 1 + i) if i % 4 else None, i % 3 or None) for i in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        feeds.context_feed(items, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    live = memory.live_context(spark.read.schema(schema).parquet(f"{tmp_path}/out"), F.lit("2026-01-09").cast("date"))
    want = {i for i, day, ttl in rows if day is None or ttl is None or dt.date(2026, 1, 9) <= day + dt.timedelta(ttl)}
    assert sorted(r.item_id for r in live.collect()) == sorted(want)


def test_replacing_feed_goes_on_and_keeps_snapshots(spark, tmp_path):
    import shutil

    def add(n: int, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, "k long, v string, seq long").coalesce(1).write.parquet(f"{tmp_path}/new{n}")
        for file in (tmp_path / f"new{n}").glob("*.parquet"):
            shutil.copy(file, tmp_path / "in" / f"{n}.parquet")

    def run() -> int:
        stream = spark.readStream.schema("k long, v string, seq long").parquet(f"{tmp_path}/in")
        feed = feeds.replacing_feed(stream, f"{tmp_path}/out", ("k",), "seq", checkpoint=f"{tmp_path}/state", buckets=8)
        feed.awaitTermination()
        return feed.lastProgress["batchId"]

    def at(n: int) -> dict:
        return {r.k: r.v for r in feeds.feed_snapshot(spark, f"{tmp_path}/out", n, spark.read.parquet(f"{tmp_path}/new0").schema).collect()}

    (tmp_path / "in").mkdir()
    add(0, [(k, "a", 0) for k in range(50)])
    first = run()
    add(1, [(3, "old", 1), (3, "b", 2), (99, "c", 1)])
    second = run()
    assert at(first) == {k: "a" for k in range(50)}
    assert at(second) == at(first) | {3: "b", 99: "c"}
    assert len(list((tmp_path / "out" / "rows" / str(second)).glob("bucket=*"))) <= 2 and second == first + 1


def test_upsert_ties_are_defined(spark):
    rows = [(1, float(i), None) for i in range(40)]
    found = {store.upsert(df.limit(0), df, ("k",)).first().v for df in (spark.createDataFrame(rows[i:] + rows[:i], "k long, v double, m map<string,string>").repartition(1 + i % 3) for i in range(0, 40, 13))}
    assert len(found) == 1


def test_context_sections(spark):
    """Sections in their order; what is null is left out; empty lists say so."""
    agents = spark.createDataFrame([("x", "S", "2026-01-01", 'said "no"', "10"), ("y", "T", "2026-01-02", None, None)], "agent_id string, symbol string, date string, latest_reason string, v string")
    agents = agents.withColumn("shadow_state", memory.structured("Shadow state", {"value": F.col("v"), "name": memory.quoted(F.col("latest_reason"))})).drop("v")
    memories = spark.createDataFrame([(1, "S", "short", 5.0, "one"), (2, "S", "short", 9.0, "two"), (3, "S", "long", 1.0, "three")], "id long, symbol string, layer string, importance double, text string")
    shared = spark.createDataFrame([("x", 1, "z", "Z", "0.5", "hello")], "target_agent_id string, position int, source_agent_id string, source_symbol string, alpha string, text string")
    got = {r.agent_id: r.context for r in memory.context(agents, memories, 2, shared).collect()}
    tail = '\n\nShadow state:\n{\n  "name": "said \\"no\\"",\n  "value": 10\n}'
    assert got["x"] == 'Agent: x\n\nSymbol: S\n\nDate: 2026-01-01\n\nLatest decision reason:\nsaid "no"\n\nShort memory:\n- two\n- one\n\nMid memory:\nNone.\n\nLong memory:\n- three\n\nReflection memory:\nNone.\n\nShared context:\n- From z (Z) alpha=0.5: hello' + tail
    assert got["y"] == "Agent: y\n\nSymbol: T\n\nDate: 2026-01-02\n\nShort memory:\nNone.\n\nMid memory:\nNone.\n\nLong memory:\nNone.\n\nReflection memory:\nNone.\n\nShared context:\nNone."


def test_text_queries_over_all_rows(spark):
    """The queries without SQL have every row, and agree with brute force beyond ASCII."""
    from tidemark import plans

    texts = ["plain", "Äé ß\nπ", "\U0001d11e a\U0001f600", "漢字\n\n", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.text_embedding3(F.col("t")).alias("v")).collect()
    assert {r.id: r.v for r in got} == {i: pytest.approx([len(t) / 1000, sum(map(ord, t)) % 997 / 997, t.count("\n") / 100]) for i, t in enumerate(texts)}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: (r.x, r.y, r.z) for r in plans.queries()["text_embedding3_all"](spark, DATA).collect()}
    assert found == {r.doc_id: tuple(round(x, 6) for x in (len(r.text) / 1000, sum(map(ord, r.text)) % 997 / 997, r.text.count("\n") / 100)) for r in docs.collect()}

    from tidemark.plans.views import view

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    before, want = {}, set()
    rows = sorted(view(spark, DATA, "news").select("published_at", "event_id", "symbol", "lang", "headline").collect())
    assert any(not r.headline.isascii() for r in rows)
    for r in rows:
        a, b = r.headline, before.get(r.lang)
        before[r.lang] = a
        if b is None or not (2 * min(len(a), len(b)) > 0.3 * (len(a) + len(b)) and 1 - edits(a, b) / max(len(a), len(b), 1) > 0.3):
            want.add((r.event_id, r.symbol))
    assert {tuple(r) for r in plans.queries()["news_near_dup_levenshtein_all"](spark, DATA).select("event_id", "symbol").collect()} == want


def test_news_near_dup_by_brute_force(spark):
    """The registered query over the whole table, with the longest common subsequence of each row and the one before it by plain dynamic programming."""
    import numpy as np
    from tidemark import plans
    from tidemark.plans.views import view

    def common(a: str, b: str) -> int:
        row, other = np.zeros(len(b) + 1, np.int32), np.array([*map(ord, b)])
        for c in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == ord(c))))
        return int(row[-1])

    rows = [r.asDict() for r in view(spark, DATA, "news").select("event_id", "symbol", "published_at", "headline", "text").collect()]
    for column, ratio in (("text", 0.6), ("headline", 0.9)):
        kept, before = [], {}
        for r in sorted(rows, key=lambda r: (r["symbol"], r["published_at"], r["event_id"])):
            a, b = r[column], before.get(r["symbol"])
            before[r["symbol"]] = a
            close = a and b and 2 * min(len(a), len(b)) > ratio * (len(a) + len(b))
            if not close or 2 * common(a, b) / (len(a) + len(b)) <= ratio:
                kept.append(r)
        rows = kept
    got = plans.queries()["news_near_dup"](spark, DATA).select("event_id").collect()
    assert sorted(r.event_id for r in got) == sorted(r["event_id"] for r in rows) and rows


def test_shares_are_between_agents(spark):
    """Two agents that send one symbol's memories to the same symbol each share for the first time; the day after, both again."""
    schema = "route_id string, date string, source_symbol string, target_symbol string, source_agent_id string, target_agent_id string, alpha double, reason string, layer string, top_k int"
    routes = spark.createDataFrame([(f"{a}{d}", f"2026-01-0{d}", "S", "T", a, "z", 0.5, "r", "short", k) for a, k in (("x", 1), ("y", 2)) for d in (1, 2)] + [("none", "2026-01-01", "Q", "T", "x", "z", 0.5, "r", "short", 5)], schema)
    memories = spark.createDataFrame([(k, "S", "short", float(k % 3), f"m{k}") for k in range(6)], "id long, symbol string, layer string, importance double, text string")
    found = {r.route_id: (r.ids, r.deduped) for r in memory.share(routes, memories, ("source_agent_id", "target_agent_id")).collect()}
    assert found == {"x1": ([2], False), "x2": ([2], True), "y1": ([2, 5], False), "y2": ([2, 5], True), "none": ([], False)}
    assert sum(r.deduped for r in memory.share(routes, memories).collect()) == 2
