"""Layered memories over the embedding table."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import memory, returns, rules, shadow
from ..sources import store
from ..streaming.sinks import shared_folder
from .market import PANEL, RETURNS, SHADOW, SIGNALS, shadows_of
from .registry import query
from .views import table, view

STATE = """state AS (SELECT id, symbol, layer, importance, delta, access_counter, exp(-delta / CASE layer WHEN 'short' THEN 3e0 WHEN 'mid' THEN 90e0 ELSE 365e0 END) AS recency, embedding,
       exp(-delta / CASE layer WHEN 'short' THEN 3e0 WHEN 'mid' THEN 90e0 ELSE 365e0 END) + least(importance, 100) / 100 AS compound FROM memories)"""
FACTORS = "CASE layer WHEN 'short' THEN 3e0 WHEN 'mid' THEN 90e0 ELSE 365e0 END", "CASE layer WHEN 'short' THEN 0.92e0 WHEN 'mid' THEN 0.967e0 ELSE 0.988e0 END"
DECAYED = f"""aged AS (SELECT id, symbol, layer, delta + 1 AS delta, exp(-(delta + 1) / {FACTORS[0]}) AS recency, importance * {FACTORS[1]} AS importance FROM state),
decayed AS (SELECT *, recency + least(importance, 100) / 100 AS compound FROM aged)"""
MEMORY_COLUMNS = ("id", "symbol", "layer", "delta")
ROUNDED = "round(importance, 6) AS importance, round(recency, 6) AS recency, round(compound, 6) AS compound"


def _jump_sql(source: str, prefix: str) -> str:
    """Two rounds of short up, mid up or down, long down, one table expression each."""
    out, last = [], source
    for k, (name, below, down, above, up) in enumerate((("short", None, None, "mid", 60), ("mid", "short", 60, "long", 80), ("long", "mid", 80, None, None)) * 2):
        rises = f"layer = '{name}' AND importance >= {up}" if up else "false"
        falls = f"layer = '{name}' AND importance < {down}" if down else "false"
        out.append(f"{prefix}{k} AS (SELECT * REPLACE (CASE WHEN {rises} THEN '{above}' WHEN {falls} THEN '{below}' ELSE layer END AS layer, CASE WHEN {rises} THEN 1 ELSE recency END AS recency, CASE WHEN {rises} THEN 0 ELSE delta END AS delta) FROM {last})")
        last = f"{prefix}{k}"
    return ",\n".join(out)


def state_of(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").withColumn("recency", F.exp(-F.col("delta") / memory.of_layer(lambda s: s[0])))
    return rows.withColumn("compound", memory.compound(F.col("recency"), F.col("importance")))


def shown(df):
    return df.select(*MEMORY_COLUMNS, *(F.round(c, 6).alias(c) for c in ("importance", "recency", "compound")))


@query(
    """WITH d AS (SELECT id, symbol, layer, ('0x' || substr(md5('0:' || CAST(id AS STRING)), 1, 8))::BIGINT % 1000 AS draw FROM memories)
SELECT id, symbol, layer, CASE layer WHEN 'short' THEN CASE WHEN draw < 500 THEN 50e0 WHEN draw < 950 THEN 70e0 ELSE 90e0 END WHEN 'mid' THEN CASE WHEN draw < 50 THEN 40e0 WHEN draw < 850 THEN 60e0 ELSE 80e0 END ELSE CASE WHEN draw < 50 THEN 40e0 WHEN draw < 200 THEN 60e0 ELSE 80e0 END END AS importance FROM d""",
    "memories",
)
def memory_insert(spark, sf_dir):
    return memory.insert(view(spark, sf_dir, "memories").select("id", "symbol", "layer")).select("id", "symbol", "layer", "importance")


@query(f"WITH {STATE}, {DECAYED} SELECT id, symbol, layer, delta, {ROUNDED} FROM decayed", "memories")
def memory_decay(spark, sf_dir):
    return shown(memory.decay(state_of(spark, sf_dir)))


@query(f"WITH {STATE} SELECT id, symbol, layer, delta, {ROUNDED} FROM state WHERE recency >= 0.05 AND importance >= 5", "memories")
def memory_cleanup(spark, sf_dir):
    return shown(memory.cleanup(state_of(spark, sf_dir)))


@query(f"WITH {STATE}, {_jump_sql('state', 'j')} SELECT id, symbol, layer, delta, {ROUNDED} FROM j5", "memories")
def memory_jump(spark, sf_dir):
    return shown(memory.jump(state_of(spark, sf_dir)))


@query(f"WITH {STATE}, {DECAYED}, clean AS (SELECT * FROM decayed WHERE recency >= 0.05 AND importance >= 5), {_jump_sql('clean', 'j')} SELECT id, symbol, layer, delta, {ROUNDED} FROM j5", "memories")
def memory_step(spark, sf_dir):
    return shown(memory.step(state_of(spark, sf_dir)))


@query(
    f"""WITH {STATE}, g AS (SELECT event_id // 4 AS id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS value, event_id FROM events WHERE event_type <> 'view'),
live AS (SELECT * FROM g WHERE id NOT IN (SELECT id FROM state WHERE recency < 0.05 OR importance < 5)),
c AS (SELECT id, sum(value) OVER (PARTITION BY id ORDER BY event_id) AS counter FROM live), s AS (SELECT id, sum(counter) AS total, count(*) AS n FROM c GROUP BY id), t AS (SELECT id, sum(value) AS v FROM live GROUP BY id)
SELECT state.id, round(importance + 5 * coalesce(total, 0), 6) AS importance, CAST(access_counter + coalesce(v, 0) AS BIGINT) AS access_counter, round(CASE WHEN n > 0 THEN recency + least(importance + 5 * total, 100) / 100 ELSE compound END, 6) AS compound FROM state LEFT JOIN s USING (id) LEFT JOIN t USING (id)""",
    "memories",
)
def memory_feedback(spark, sf_dir):
    state = state_of(spark, sf_dir)
    value = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1)
    given = table(spark, sf_dir, "events").where("event_type != 'view'").select(F.expr("event_id div 4").alias("id"), value.alias("value"), F.col("event_id").alias("seq"))
    found = memory.feedback(state, given, memory.removed(state))
    return found.select("id", F.round("importance", 6).alias("importance"), F.col("access_counter").cast("long").alias("access_counter"), F.round("compound", 6).alias("compound"))


def _days_sql(legacy: bool) -> str:
    """DuckDB SQL of memory.run_days over three days of events: on day d memories of id % 5 = d come in, those of 0 are there."""
    draw = "('0x' || substr(md5('0:' || CAST(id AS STRING)), 1, 8))::BIGINT % 1000"
    drawn = f"CASE layer WHEN 'short' THEN CASE WHEN {draw} < 500 THEN 50e0 WHEN {draw} < 950 THEN 70e0 ELSE 90e0 END WHEN 'mid' THEN CASE WHEN {draw} < 50 THEN 40e0 WHEN {draw} < 850 THEN 60e0 ELSE 80e0 END ELSE CASE WHEN {draw} < 50 THEN 40e0 WHEN {draw} < 200 THEN 60e0 ELSE 80e0 END END"
    out, last, gone = ["v0 AS (SELECT id, symbol, layer, importance, recency, delta, access_counter FROM state WHERE id % 5 = 0)", "g0 AS (SELECT id FROM state WHERE false)"], "v0", "g0"
    for d in (1, 2, 3):
        out += [
            f"i{d} AS (SELECT * FROM {last} UNION ALL SELECT id, symbol, layer, {drawn}, 1e0, 0, 0 FROM memories WHERE id % 5 = {d})",
            f"f{d} AS (SELECT event_id // 4 AS id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS value, event_id FROM events WHERE event_type <> 'view' AND event_id % 3 + 1 = {d} AND event_id // 4 NOT IN (SELECT id FROM {gone}))",
            f"c{d} AS (SELECT id, value, sum(value) OVER (PARTITION BY id ORDER BY event_id) AS counter FROM f{d})",
            f"s{d} AS (SELECT id, sum(value) AS v, sum(counter) AS total, count(*) AS n FROM c{d} GROUP BY id)",
            f"a{d} AS (SELECT i.id, symbol, layer, (importance + 5 * (coalesce(n, 0) * access_counter + coalesce(total, 0))) * {FACTORS[1]} AS importance, exp(-(delta + 1) / {FACTORS[0]}) AS recency, delta + 1 AS delta, CAST(access_counter + coalesce(v, 0) AS BIGINT) AS access_counter FROM i{d} i LEFT JOIN s{d} USING (id))",
            f"k{d} AS (SELECT * FROM a{d} WHERE recency >= 0.05 AND importance >= 5)",
            _jump_sql(f"k{d}", f"j{d}_"),
            f"g{d} AS (SELECT id FROM {gone} UNION SELECT id FROM a{d} WHERE recency < 0.05 OR importance < 5" + (f" UNION SELECT j.id FROM j{d}_5 j JOIN a{d} a USING (id) WHERE j.layer <> a.layer" if legacy else "") + ")",
        ]
        last, gone = f"j{d}_5", f"g{d}"
    return f"WITH {STATE},\n" + ",\n".join(out) + f" SELECT id, symbol, layer, delta, access_counter, round(importance, 6) AS importance, round(recency, 6) AS recency FROM {last}"


def days_of(spark, sf_dir, legacy):
    state, path = state_of(spark, sf_dir), f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    value = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1)
    given = table(spark, sf_dir, "events").where("event_type != 'view'").select(F.expr("event_id div 4").alias("id"), value.alias("value"), F.col("event_id").alias("seq"))
    days = [(f"2024-01-0{d}", state.where(F.col("id") % 5 == d), given.where(F.col("seq") % 3 + 1 == d)) for d in (1, 2, 3)]
    memory.run_days(path, state.where("id % 5 = 0"), days[:2], legacy)  # as if it had been stopped here
    found = memory.run_days(path, state.where("id % 5 = 0"), days, legacy)
    return found.select("id", "symbol", "layer", "delta", "access_counter", F.round("importance", 6).alias("importance"), F.round("recency", 6).alias("recency"))


@query(_days_sql(False), "memories")
def memory_days(spark, sf_dir):
    return days_of(spark, sf_dir, False)


@query(_days_sql(True), "memories")
def memory_days_legacy(spark, sf_dir):
    return days_of(spark, sf_dir, True)


def cosine_sql(a: str, b: str) -> str:
    d = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    return f"{d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)}))"


@query(f"WITH s AS (SELECT q.id AS query_id, v.id, {cosine_sql('q.embedding', 'v.embedding')} AS score FROM memories q, memories v WHERE q.id % 100 = 0) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10", "memories")
def knn_cosine(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").select("id", "embedding")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return memory.nearest(queries, rows, 10).withColumn("score", F.round("score", 6))


@query("WITH s AS (SELECT q.id AS query_id, v.id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS score FROM memories q, memories v WHERE q.id % 100 = 0) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s) WHERE rank <= 10", "memories")
def knn_l2(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").select("id", "embedding")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return memory.nearest(queries, rows, 10, "l2").withColumn("score", F.round("score", 6))


def _hybrid_sql(keys: str) -> str:
    on = " AND ".join(f"m.{k} = q.{k}" for k in keys.split(", "))
    return f"""WITH {STATE}, q AS (SELECT {keys}, max(id) AS query_id, max_by(embedding, id) AS query FROM state GROUP BY {keys}),
j AS (SELECT q.query_id, {", ".join("m." + k for k in keys.split(", "))}, m.id, m.compound, {cosine_sql("q.query", "m.embedding")} AS sim FROM state m JOIN q ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY compound, id) AS r2 FROM j),
u AS (SELECT query_id, {keys}, id, sim + compound AS score, 1 AS copy FROM r WHERE r1 <= 3 UNION ALL SELECT query_id, {keys}, id, sim + compound, 2 FROM r WHERE r2 <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC, copy) AS best FROM u)
SELECT query_id, {keys}, id, round(max(score), 6) AS score FROM b WHERE best <= 3 GROUP BY query_id, {keys}, id"""


def hybrid_of(spark, sf_dir, keys):
    state = state_of(spark, sf_dir)
    queries = state.groupBy(*keys).agg(F.max("id").alias("query_id"), F.max_by("embedding", "id").alias("query"))
    return memory.hybrid_query(state, queries, 3, keys).withColumn("score", F.round("score", 6))


@query(_hybrid_sql("symbol"), "memories")
def memory_query(spark, sf_dir):
    return hybrid_of(spark, sf_dir, ("symbol",))


@query(_hybrid_sql("symbol, layer"), "memories")
def memory_query_layers(spark, sf_dir):
    return hybrid_of(spark, sf_dir, ("symbol", "layer"))


@query(
    f"""WITH h AS ({_hybrid_sql("symbol, layer")}), a AS (SELECT agent_id, replace(symbol, 'U', 'L') AS symbol, max(date) AS date FROM decisions GROUP BY 1, 2)
SELECT h.id AS memory_id, h.layer, h.symbol, a.date, a.agent_id AS source_agent_id, substring(d.text, 1, 160) AS text_preview FROM h JOIN a ON a.symbol = h.symbol JOIN documents d ON d.doc_id = h.id""",
    "memories decisions",
)
def memory_references(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    decided = view(spark, sf_dir, "decisions").withColumn("symbol", F.replace("symbol", F.lit("U"), F.lit("L")))
    agents = decided.groupBy("agent_id", "symbol").agg(F.max("date").alias("date"))
    return memory.references(hybrid_of(spark, sf_dir, ("symbol", "layer")), texts, agents)


def _asof_parts(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").select("id", "embedding")
    metadata = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("available_at"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.lit("2024-01-01 18:00:00").cast("timestamp_ntz").alias("as_of"))
    return queries, rows, metadata


ASOF = f"""WITH s AS (SELECT q.id AS query_id, v.id, {cosine_sql('q.embedding', 'v.embedding')} AS score FROM memories q, memories v WHERE q.id % 100 = 0 {{0}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s), o AS (SELECT r.* FROM r JOIN events e ON e.event_id = r.id WHERE {{1}} e.ts <= TIMESTAMP '2024-01-01 18:00:00')
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM o) WHERE rank <= 5"""


@query(ASOF.format("", "r <= 10 AND"), "memories")
def vector_search_asof(spark, sf_dir):
    return memory.search_as_of(*_asof_parts(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query(ASOF.format("", ""), "memories")
def vector_search_prefiltered(spark, sf_dir):
    return memory.search_as_of(*_asof_parts(spark, sf_dir), 5, prefilter=True).withColumn("score", F.round("score", 6))


@query(
    f"""WITH q AS (SELECT m.id AS query_id, m.embedding AS query, e.ts AS as_of FROM memories m JOIN events e ON e.event_id = m.id WHERE m.id % 100 = 0),
kept AS (SELECT event_id AS id, ts AS available_at FROM events WHERE event_type = 'purchase'),
s AS (SELECT query_id, as_of, v.id, {cosine_sql("q.query", "v.embedding")} AS score FROM q, memories v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
h AS (SELECT r.*, available_at FROM r JOIN kept ON kept.id = r.id WHERE r <= 4),
o AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM h WHERE available_at <= as_of),
n AS (SELECT query_id, kept.id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(available_at AS DATE) DESC, available_at DESC, kept.id) AS rank FROM q JOIN kept ON available_at <= as_of WHERE query_id NOT IN (SELECT query_id FROM h))
SELECT query_id, id, round(score, 6) AS score, rank FROM o WHERE rank <= 2 UNION ALL SELECT query_id, id, NULL, rank FROM n WHERE rank <= 2""",
    "memories",
)
def vector_search_fallback(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("event_date"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"))
    rows = view(spark, sf_dir, "memories").select("id", "embedding")
    moments = events.select(F.col("event_id").alias("id"), F.col("ts").alias("as_of"))
    queries = rows.where("id % 100 = 0").join(moments, "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), "as_of")
    return memory.search_or_newest(queries, rows, kept, 2).withColumn("score", F.round("score", 6))


@query("SELECT m.id, m.symbol, m.layer FROM memories m JOIN events e ON e.event_id = m.id WHERE m.layer = 'mid' AND m.symbol = 'L3' AND e.ts <= TIMESTAMP '2024-01-02 00:00:00' ORDER BY CAST(e.ts AS DATE) DESC, e.ts DESC, m.id LIMIT 7", "memories")
def memory_metadata_search(spark, sf_dir):
    when = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("event_date"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"))
    rows = view(spark, sf_dir, "memories").join(when, "id").withColumn("memory_id", F.col("id"))
    return store.metadata_search(rows, 7, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), layer="mid", symbol="L3").select("id", "symbol", "layer")


@query(
    """WITH t AS (SELECT DISTINCT symbol FROM memories), r AS (SELECT concat(a.symbol, '>', b.symbol, '@', d.day) AS route_id, d.day::DATE AS date, a.symbol AS source_symbol, b.symbol AS target_symbol, 0.5e0 AS alpha FROM t a JOIN t b ON a.symbol < b.symbol, (VALUES ('2024-01-01'), ('2024-01-02')) d(day)),
m AS (SELECT *, concat('memory ', CAST(id AS STRING)) AS text, row_number() OVER (PARTITION BY symbol ORDER BY importance DESC, id) AS k FROM memories WHERE layer = 'short'),
s AS (SELECT symbol, string_agg(CAST(id AS STRING), ',' ORDER BY k) AS ids, string_agg('- ' || text, chr(10) ORDER BY k) AS body FROM m WHERE k <= 3 GROUP BY symbol)
SELECT route_id, date, source_symbol, target_symbol, coalesce(ids, '') AS ids, concat(printf('Shared from %s to %s. Graph influence alpha=%.3f. Reason: %s', source_symbol, target_symbol, alpha, 'demo'), chr(10), coalesce(body, '- No source memory returned.')) AS text,
       row_number() OVER (PARTITION BY source_symbol, target_symbol, coalesce(ids, '') ORDER BY date, route_id) > 1 AS deduped FROM r LEFT JOIN s ON s.symbol = r.source_symbol""",
    "memories",
)
def memory_share(spark, sf_dir):
    rows = view(spark, sf_dir, "memories")
    a, b = rows.select(F.col("symbol").alias("source_symbol")).distinct(), rows.select(F.col("symbol").alias("target_symbol")).distinct()
    day = F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-01-02")))
    routes = a.join(b, F.col("source_symbol") < F.col("target_symbol")).withColumn("day", day)
    routes = routes.select(F.concat("source_symbol", F.lit(">"), "target_symbol", F.lit("@"), "day").alias("route_id"), F.col("day").cast("date").alias("date"), "source_symbol", "target_symbol", F.lit(0.5).alias("alpha"), F.lit("demo").alias("reason"), F.lit("short").alias("layer"), F.lit(3).alias("top_k"))
    found = memory.share(routes, rows.withColumn("text", F.concat(F.lit("memory "), F.col("id").cast("string"))))
    return found.select("route_id", "date", "source_symbol", "target_symbol", F.array_join("ids", ",").alias("ids"), "text", "deduped")


_SECTION = "concat('{0} memory:', chr(10), coalesce((SELECT string_agg('- memory ' || CAST(id AS STRING), chr(10) ORDER BY k) FROM m WHERE m.symbol = a.symbol AND layer = '{1}' AND k <= 2), 'None.'))"


@query(
    """WITH last_ AS (SELECT agent_id, symbol, max_by(decision, date) AS decision, max(date) AS date, count(*) AS n FROM decisions GROUP BY agent_id, symbol),
a AS (SELECT agent_id, replace(symbol, 'U', 'L') AS symbol, decision, date, n, row_number() OVER (PARTITION BY agent_id, replace(symbol, 'U', 'L') ORDER BY date DESC) AS k FROM last_),
m AS (SELECT id, symbol, layer, row_number() OVER (PARTITION BY symbol, layer ORDER BY importance DESC, id) AS k FROM memories),
t AS (SELECT symbol, layer, string_agg(concat('- memory ', id), chr(10) ORDER BY k) AS body FROM m WHERE k <= 2 GROUP BY symbol, layer),
s AS (SELECT agent_id, string_agg(concat('- From ', source, ' (', symbol, ') alpha=0.', lpad(CAST(id % 1000 AS STRING), 3, '0'), ': memory ', id), chr(10) ORDER BY id) AS body
      FROM (SELECT concat('agent_', event_type) AS agent_id, concat('agent_', lag(event_type) OVER (ORDER BY event_type)) AS source FROM (SELECT DISTINCT event_type FROM events)) r JOIN memories ON id % 50 = length(source) AND layer = 'reflection' GROUP BY agent_id)
SELECT a.agent_id, a.symbol, a.date, concat('Agent: ', a.agent_id, chr(10), chr(10), 'Symbol: ', a.symbol, chr(10), chr(10), 'Date: ', CAST(a.date AS STRING), chr(10), chr(10),
       CASE WHEN a.decision <> 'hold' THEN concat('Latest decision reason:', chr(10), 'last was ', a.decision, chr(10), chr(10)) ELSE '' END,
       'Short memory:', chr(10), coalesce(t1.body, 'None.'), chr(10), chr(10), 'Mid memory:', chr(10), coalesce(t2.body, 'None.'), chr(10), chr(10),
       'Long memory:', chr(10), coalesce(t3.body, 'None.'), chr(10), chr(10), 'Reflection memory:', chr(10), coalesce(t4.body, 'None.'), chr(10), chr(10),
       'Shared context:', chr(10), coalesce(s.body, 'None.'), chr(10), chr(10), 'Shadow state:', chr(10), '{', chr(10), '  "n_updates": ', a.n, ',', chr(10), '  "symbol": "', a.symbol, '"', chr(10), '}',
       CASE WHEN a.n % 2 = 0 THEN concat(chr(10), chr(10), 'Psychology state:', chr(10), '{', chr(10), '  "last_decision": "', a.decision, '"', chr(10), '}') ELSE '' END) AS context
FROM a LEFT JOIN t t1 ON t1.symbol = a.symbol AND t1.layer = 'short' LEFT JOIN t t2 ON t2.symbol = a.symbol AND t2.layer = 'mid'
LEFT JOIN t t3 ON t3.symbol = a.symbol AND t3.layer = 'long' LEFT JOIN t t4 ON t4.symbol = a.symbol AND t4.layer = 'reflection' LEFT JOIN s ON s.agent_id = a.agent_id WHERE a.k = 1""",
    "decisions memories",
)
def agent_context(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").withColumn("text", F.concat(F.lit("memory "), F.col("id").cast("string")))
    decided = view(spark, sf_dir, "decisions").withColumn("symbol", F.replace("symbol", F.lit("U"), F.lit("L")))
    agents = decided.groupBy("agent_id", "symbol").agg(F.max_by("decision", "date").alias("decision"), F.max("date").alias("date"), F.count("*").cast("string").alias("n"))
    agents = agents.select(
        "agent_id", "symbol", "date",
        F.when(F.col("decision") != "hold", F.concat(F.lit("last was "), "decision")).alias("latest_reason"),
        memory.structured("Shadow state", {"symbol": memory.quoted(F.col("symbol")), "n_updates": F.col("n")}).alias("shadow_state"),
        F.when(F.col("n").cast("int") % 2 == 0, memory.structured("Psychology state", {"last_decision": memory.quoted(F.col("decision"))})).alias("psychology_state"),
    )
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    routes = kinds.select(F.concat(F.lit("agent_"), "event_type").alias("target_agent_id"), F.concat(F.lit("agent_"), F.lag("event_type").over(Window.orderBy("event_type"))).alias("source_agent_id"))  # one row per kind of event
    alpha = F.concat(F.lit("0."), F.lpad((F.col("id") % 1000).cast("string"), 3, "0")).alias("alpha")
    shared = routes.join(rows.where("layer = 'reflection'"), F.col("id") % 50 == F.length("source_agent_id")).select("target_agent_id", F.col("id").alias("position"), "source_agent_id", F.col("symbol").alias("source_symbol"), alpha, "text")
    return memory.context(agents, rows, 2, shared)


_FIELD = "printf('%.4f', {0})"
_STATE_SQL = f"""st AS (SELECT agent_id, replace(symbol, 'U', 'L') AS symbol, date, round(value, 4) AS value, round(roi, 4) AS roi, round(sharpe, 4) AS sharpe, round(drawdown, 4) AS drawdown, round(win_rate, 4) AS win_rate
       FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, symbol ORDER BY date DESC) AS k FROM shadow) WHERE k = 1 AND replace(symbol, 'U', 'L') IN (SELECT symbol FROM memories)),
ps AS (SELECT *, roi <= -0.03 AS f1, drawdown <= -0.08 AS f2, win_rate <= 0.45 AND (roi < 0 OR drawdown < 0) AS f3, roi >= 0.05 AND drawdown >= -0.03 AND win_rate >= 0.55 AS g FROM st),
said AS (SELECT *, CASE WHEN f1 OR f2 OR f3 THEN 'fear' WHEN g THEN 'greed' ELSE 'neutral' END AS state, CASE WHEN f1 OR f2 OR f3 THEN 'risk_averse' WHEN g THEN 'risk_seeking' ELSE 'balanced' END AS attitude,
       CASE WHEN f1 OR f2 OR f3 THEN concat_ws('; ', CASE WHEN f1 THEN printf('ROI %.4f is below fear threshold', roi) END, CASE WHEN f2 THEN printf('drawdown %.4f is beyond fear threshold', drawdown) END, CASE WHEN f3 THEN printf('win rate %.4f is weak', win_rate) END)
            WHEN g THEN printf('ROI %.4f is above greed threshold; drawdown %.4f is controlled; win rate %.4f is strong', roi, drawdown, win_rate) ELSE 'Shadow metrics do not show a strong greed or fear regime.' END AS reason FROM ps)"""


@query(
    f"""WITH {PANEL}, {SIGNALS}, {RETURNS}, {SHADOW}, {_STATE_SQL},
m AS (SELECT id, symbol, layer, row_number() OVER (PARTITION BY symbol, layer ORDER BY importance DESC, id) AS k FROM memories),
t AS (SELECT symbol, layer, string_agg(concat('- memory ', id), chr(10) ORDER BY k) AS body FROM m WHERE k <= 2 GROUP BY symbol, layer),
o AS (SELECT *, lag(agent_id) OVER (PARTITION BY symbol ORDER BY agent_id) AS source, lag(roi) OVER (PARTITION BY symbol ORDER BY agent_id) AS source_roi, lag(date) OVER (PARTITION BY symbol ORDER BY agent_id) AS source_date FROM said),
live AS (SELECT *, round(least(1, abs(source_roi)), 3) AS alpha FROM o WHERE source IS NOT NULL AND DATE '2024-01-30' <= source_date + 3),
sent AS (SELECT agent_id, concat('- From ', source, ' (', l.symbol, ') alpha=', printf('%.3f', alpha), ': Shared from ', l.symbol, ' to ', l.symbol, '. Graph influence alpha=', printf('%.3f', alpha), '. Reason: ', source, ' is ', attitude, chr(10), coalesce(t.body, '- No source memory returned.')) AS line, l.symbol
         FROM live l LEFT JOIN t ON t.symbol = l.symbol AND t.layer = 'short'),
s AS (SELECT agent_id, string_agg(line, chr(10) ORDER BY symbol) AS body FROM sent GROUP BY agent_id),
d AS (SELECT agent_id, replace(symbol, 'U', 'L') AS symbol, max_by(decision, date) AS decision FROM decisions GROUP BY 1, 2)
SELECT a.agent_id, a.symbol, a.date, concat('Agent: ', a.agent_id, chr(10), chr(10), 'Symbol: ', a.symbol, chr(10), chr(10), 'Date: ', CAST(a.date AS STRING), chr(10), chr(10), 'Latest decision reason:', chr(10), 'last was ', decision, chr(10), chr(10),
       'Short memory:', chr(10), coalesce(t1.body, 'None.'), chr(10), chr(10), 'Mid memory:', chr(10), coalesce(t2.body, 'None.'), chr(10), chr(10),
       'Long memory:', chr(10), coalesce(t3.body, 'None.'), chr(10), chr(10), 'Reflection memory:', chr(10), coalesce(t4.body, 'None.'), chr(10), chr(10), 'Shared context:', chr(10), coalesce(s.body, 'None.'), chr(10), chr(10),
       'Shadow state:', chr(10), '{{', chr(10), '  "drawdown": ', {_FIELD.format("drawdown")}, ',', chr(10), '  "roi": ', {_FIELD.format("roi")}, ',', chr(10), '  "sharpe": ', {_FIELD.format("sharpe")}, ',', chr(10), '  "value": ', {_FIELD.format("value")}, ',', chr(10), '  "win_rate": ', {_FIELD.format("win_rate")}, chr(10), '}}', chr(10), chr(10),
       'Psychology state:', chr(10), '{{', chr(10), '  "reason": "', reason, '",', chr(10), '  "risk_attitude": "', attitude, '",', chr(10), '  "state": "', state, '"', chr(10), '}}') AS context
FROM said a JOIN d USING (agent_id, symbol) LEFT JOIN t t1 ON t1.symbol = a.symbol AND t1.layer = 'short' LEFT JOIN t t2 ON t2.symbol = a.symbol AND t2.layer = 'mid'
LEFT JOIN t t3 ON t3.symbol = a.symbol AND t3.layer = 'long' LEFT JOIN t t4 ON t4.symbol = a.symbol AND t4.layer = 'reflection' LEFT JOIN s ON s.agent_id = a.agent_id""",
    "bars decisions memories",
)
def agent_context_state(spark, sf_dir):
    """Contexts from what is known of the agents: their last shadow states, the psychology on them, and live shares of memories.

    An agent gets the short memories of its symbols from the agent before it, weighted by that one's return, for three days.
    """
    rows = view(spark, sf_dir, "memories").withColumn("text", F.concat(F.lit("memory "), F.col("id").cast("string")))
    renamed = F.replace("symbol", F.lit("U"), F.lit("L")).alias("symbol")
    figures = ("value", "roi", "sharpe", "drawdown", "win_rate")
    states = shadow.latest(shadows_of(spark, sf_dir), "agent_id", "symbol").select("agent_id", renamed, "date", *(F.round(c, 4).alias(c) for c in figures))
    states = rules.psychology(states.join(rows.select("symbol").distinct(), "symbol", "left_semi"))
    decided = view(spark, sf_dir, "decisions").groupBy("agent_id", renamed).agg(F.concat(F.lit("last was "), F.max_by("decision", "date")).alias("latest_reason"))
    agents = states.join(decided, ["agent_id", "symbol"]).select(
        "agent_id", "symbol", "date", "latest_reason",
        memory.structured("Shadow state", {c: F.format_string("%.4f", c) for c in figures}).alias("shadow_state"),
        memory.structured("Psychology state", {c: memory.quoted(F.col(c)) for c in ("state", "risk_attitude", "reason")}).alias("psychology_state"),
    )
    before = Window.partitionBy("symbol").orderBy("agent_id")
    routes = states.select(F.col("agent_id").alias("target_agent_id"), F.lag("agent_id").over(before).alias("source_agent_id"), F.lag("roi").over(before).alias("source_roi"), F.lag("date").over(before).alias("created_at"), "symbol", "risk_attitude").where("source_agent_id is not null")
    routes = memory.live_context(routes.withColumn("ttl_days", F.lit(3)), F.lit("2024-01-30").cast("date"))
    told = F.concat("source_agent_id", F.lit(" is "), "risk_attitude").alias("reason")
    routes = routes.select(F.concat_ws("|", "target_agent_id", "symbol").alias("route_id"), F.col("created_at").alias("date"), F.col("symbol").alias("source_symbol"), F.col("symbol").alias("target_symbol"), "source_agent_id", "target_agent_id", F.round(F.least(F.lit(1.0), F.abs("source_roi")), 3).alias("alpha"), told, F.lit("short").alias("layer"), F.lit(2).alias("top_k"))
    sent = memory.share(routes, rows, ("source_agent_id", "target_agent_id")).join(routes.select("route_id", F.format_string("%.3f", "alpha").alias("alpha")), "route_id")
    return memory.context(agents, rows, 2, sent.withColumn("position", F.col("source_symbol")))


@query("SELECT symbol, seen_at, momentum, CASE momentum WHEN -1 THEN 'The cumulative return of past 3 days for this stock is negative.' WHEN 0 THEN 'The cumulative return of past 3 days for this stock is zero.' WHEN 1 THEN 'The cumulative return of past 3 days for this stock is positive.' ELSE '' END AS note FROM (SELECT symbol, date AS seen_at, CAST(sign(close - lag(close, 3) OVER (PARTITION BY symbol ORDER BY date)) AS INTEGER) AS momentum FROM bars)", "bars")
def momentum_note(spark, sf_dir):
    return returns.momentum(view(spark, sf_dir, "bars")).select("symbol", "seen_at", "momentum", memory.momentum_sentence(F.col("momentum")).alias("note"))


@query(
    """WITH g AS (SELECT DISTINCT symbol FROM memories), l AS (SELECT symbol, unnest(['short', 'mid', 'long', 'reflection']) AS layer FROM g),
k AS (SELECT symbol, layer, id, importance, row_number() OVER (PARTITION BY symbol, layer ORDER BY importance DESC, id) AS k FROM memories),
m AS (SELECT symbol, layer, list(id ORDER BY importance DESC, id) AS ids FROM k WHERE k <= 3 GROUP BY symbol, layer),
p AS (SELECT l.symbol, l.layer, CASE WHEN ids IS NULL THEN [-1, -1] WHEN len(ids) = 1 THEN [ids[1], ids[1]] ELSE ids END AS ids FROM l LEFT JOIN m ON l.symbol = m.symbol AND l.layer = m.layer)
SELECT symbol, layer, array_to_string(ids, ',') AS ids, array_to_string(list_transform(ids, lambda x: CASE WHEN x = -1 THEN concat('No ', layer, '-term information.') ELSE concat('memory ', x) END), '|') AS texts FROM p""",
    "memories",
)
def memory_placeholders(spark, sf_dir):
    rows = view(spark, sf_dir, "memories").withColumn("text", F.concat(F.lit("memory "), F.col("id").cast("string")))
    return memory.with_placeholders(rows, rows).select("symbol", "layer", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("texts", "|").alias("texts"))


@query("SELECT event_id, created_at, ttl_days FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS created_at, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 7 AS INTEGER) END AS ttl_days FROM events) WHERE ttl_days IS NULL OR created_at IS NULL OR DATE '2024-01-15' <= created_at + ttl_days")
def shared_context_live(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 11 = 0 then null else cast(ts as date) end as created_at", "case when event_id % 7 = 0 then null else cast(event_id % 7 as int) end as ttl_days")
    return memory.live_context(rows, F.lit("2024-01-15").cast("date"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM conversations),
b AS (SELECT *, len(words) AS n, coalesce(sum(len(words)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
t AS (SELECT *, greatest(0, least(n, 320 - before)) AS taken FROM b)
SELECT conv_id, turn, CAST(n AS BIGINT) AS n_tokens, CAST(taken AS BIGINT) AS taken, sha256(CASE WHEN taken < n THEN array_to_string(words[1:taken], ' ') ELSE text END) AS text_sha256 FROM t WHERE taken > 0"""
)
def token_budget_pack(spark, sf_dir):
    packed = memory.pack_tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), 320, ("conv_id",), "turn")
    return packed.select("conv_id", "turn", "n_tokens", "taken", F.sha2("text", 256).alias("text_sha256"))
