"""Rule operators: psychology states, conflict modes, verdicts and debate texts, as expressions over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import decision_signal, is_valid_decision, normal_decision

#: Thresholds of greed and fear.
GREED = {"roi": 0.05, "drawdown": -0.03, "win_rate": 0.55}
FEAR = {"roi": -0.03, "drawdown": -0.08, "win_rate": 0.45}
#: From here on a double's shortest digits may end before its fourth place; from there on it is no long.
LONG, NO_LONG = 1e11, 9.2e18


def four_places(x: Column) -> Column:
    """A number with four places, in the digits that the double has: Java writes zeros behind a double's shortest digits."""
    long = F.when((F.abs(x) >= LONG) & (F.abs(x) < NO_LONG), x)
    whole = long.cast("long")
    digits = F.bround(whole.cast("decimal(38, 18)") + (long - whole).cast("decimal(38, 18)"), 4).cast("decimal(38, 4)").cast("string")
    return F.when(long.isNotNull(), digits).when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.4f", x))


def psychology(states: DataFrame) -> DataFrame:
    """Adds state (fear beats greed beats neutral), risk_attitude and reason from roi, drawdown and win_rate; nulls speak for nothing."""
    roi, fall, wins = F.col("roi"), F.col("drawdown"), F.col("win_rate")
    none = lambda c: F.coalesce(c, F.lit(False))
    texts = {"ROI": four_places(roi), "drawdown": four_places(fall), "win rate": F.format_string("%.4f", wins)}
    say = lambda name, how: F.concat(F.lit(f"{name} "), texts[name], F.lit(f" {how}"))
    fears = [
        (none(roi <= FEAR["roi"]), say("ROI", "is below fear threshold")),
        (none(fall <= FEAR["drawdown"]), say("drawdown", "is beyond fear threshold")),
        (none(wins <= FEAR["win_rate"]) & (none(roi < 0) | none(fall < 0)), say("win rate", "is weak")),
    ]
    hopes = [
        (none(roi >= GREED["roi"]), say("ROI", "is above greed threshold")),
        (none(fall >= GREED["drawdown"]), say("drawdown", "is controlled")),
        (none(wins >= GREED["win_rate"]), say("win rate", "is strong")),
    ]
    said = lambda pairs: F.concat_ws("; ", *(F.when(c, text) for c, text in pairs))
    fear = fears[0][0] | fears[1][0] | fears[2][0]
    greed = hopes[0][0] & (fall.isNull() | hopes[1][0]) & (wins.isNull() | hopes[2][0])
    unknown = roi.isNull() & fall.isNull() & wins.isNull()
    state = F.when(fear, "fear").when(greed, "greed").otherwise("neutral")
    neutral = F.when(unknown, "No shadow portfolio metrics are available yet.").otherwise("Shadow metrics do not show a strong greed or fear regime.")
    reason = F.when(fear, said(fears)).when(greed, said(hopes)).otherwise(neutral)
    attitude = F.when(fear, "risk_averse").when(greed, "risk_seeking").otherwise("balanced")
    return states.withColumns({"state": state, "risk_attitude": attitude, "reason": reason})


def conflict(text_signal: Column, graph_signal: Column, score: Column) -> Column:
    """Whether the score is in the grey zone or the signals differ."""
    return score.between(0.3, 0.7) | (text_signal != graph_signal)


def decision_mode(text_signal: Column, graph_signal: Column, score: Column) -> Column:
    return F.when(conflict(text_signal, graph_signal, score), "debate").when((score > 0.8) | (score < 0.2), "fast_execution").otherwise("review")


def verdict(decision: Column, graph_signal: Column, score: Column) -> Column:
    word = normal_decision(decision)
    against_buy = (word == "buy") & (graph_signal < 0)
    return (
        F.when(score <= 0.25, "override_sell")
        .when(against_buy & (score <= 0.45), "reduce")
        .when(against_buy, "override_hold")
        .when((word == "sell") & (graph_signal > 0), "reduce")
        .when(score.between(0.3, 0.7), "reduce")
        .otherwise("keep")
    )


def judged(requests: DataFrame) -> DataFrame:
    """requests: decision, graph_signal, fusion_score. Adds text_signal, mode, verdict, target_decision and the judge's reason."""
    rows = requests.withColumn("text_signal", decision_signal(F.col("decision")))
    rows = rows.withColumn("mode", decision_mode(F.col("text_signal"), F.col("graph_signal"), F.col("fusion_score")))
    rows = rows.withColumn("verdict", verdict(F.col("decision"), F.col("graph_signal"), F.col("fusion_score")))
    target = F.when(F.col("verdict") == "override_sell", "sell").when(F.col("verdict") == "override_hold", "hold")
    reason = F.format_string("Rule-based judge: fusion_score=%.3f, text_signal=%d, graph_signal=%d, local_decision=%s, verdict=%s.", "fusion_score", "text_signal", "graph_signal", "decision", "verdict")
    return rows.withColumns({"target_decision": target, "reason": reason})


def transcripts(requests: DataFrame, references: DataFrame) -> DataFrame:
    """Question and answer of each debate, citing memory references (request_id, layer, memory_id) in their order."""
    cited = references.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "layer", F.col("memory_id").cast("string")).alias("name")))).alias("cited"))
    rows = requests.join(cited, "request_id", "left")
    names = F.coalesce(F.array_join(F.transform("cited", lambda x: x["name"]), ", "), F.lit("no cited memory"))
    question = F.format_string("Graph risk conflicts with the local decision for %s. Local decision=%s, text_signal=%d, graph_signal=%d, fusion_score=%.3f. Justify the local decision using cited memory ids.", "symbol", "decision", "text_signal", "graph_signal", "fusion_score")
    answer = F.format_string("Local decision is %s. Reason: %s. Cited memory: %s.", F.col("decision"), F.col("reason"), names)
    return rows.select("request_id", "symbol", question.alias("question"), answer.alias("answer"))


def agents_context(requests: DataFrame, by_agent: DataFrame, by_symbol: DataFrame, column: str) -> DataFrame:
    """A state looked up by agent, else by symbol."""
    a, b = by_agent.select("agent_id", F.col(column).alias("_own")), by_symbol.select("symbol", F.col(column).alias("_other"))
    return requests.join(a, "agent_id", "left").join(b, "symbol", "left").withColumn(column, F.coalesce("_own", "_other")).drop("_own", "_other")


#: Fields of a recorded reflection that hold memory indexes, and their layers.
INDEX_FIELDS = {"short_memory_index": "short", "middle_memory_index": "mid", "long_memory_index": "long", "reflection_memory_index": "reflection"}
REFLECTION = "investment_decision string, summary_reason string, " + ", ".join(f"{name} array<struct<memory_index:bigint>>" for name in INDEX_FIELDS)


def reflections(rows: DataFrame, column: str = "reflection") -> DataFrame:
    """Parses recorded reflections (JSON): decision, signal, parse_ok, reason, and memory references as ``layer:id`` (null and -1 ids left out)."""
    parsed = rows.withColumn("_r", F.from_json(column, REFLECTION))

    def references(name: str, layer: str) -> Column:
        items = F.coalesce(F.col(f"_r.{name}"), F.array().cast("array<struct<memory_index:bigint>>"))
        real = F.filter(items, lambda x: x["memory_index"].isNotNull() & (x["memory_index"] != -1))
        return F.transform(real, lambda x: F.concat(F.lit(f"{layer}:"), x["memory_index"].cast("string")))

    refs = [references(name, layer) for name, layer in INDEX_FIELDS.items()]
    decision = F.col("_r.investment_decision")
    return parsed.withColumns({
        "decision": normal_decision(F.coalesce(decision, F.lit(""))),
        "action_signal": decision_signal(F.coalesce(decision, F.lit(""))),
        "parse_ok": is_valid_decision(decision),
        "reason": F.coalesce(F.nullif(F.col("_r.summary_reason"), F.lit("")), F.lit("No valid LLM reflection output; defaulting to hold.")),
        "memory_refs": F.concat(*refs),
    }).drop("_r", column)
