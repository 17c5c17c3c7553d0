"""Scored memories in four layers: insert, decay, cleanup, promotion, feedback, search and sharing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.written import complete, written
from . import segments
from .neighbours import nearest

#: Fixed values of each layer: recency factor, importance factor, jump up at, jump down below, importance draws and their cumulative shares in thousandths.
LAYERS = {
    "short": (3.0, 0.92, 60.0, None, (50.0, 70.0, 90.0), (500, 950)),
    "mid": (90.0, 0.967, 80.0, 60.0, (40.0, 60.0, 80.0), (50, 850)),
    "long": (365.0, 0.988, None, 80.0, (40.0, 60.0, 80.0), (50, 200)),
    "reflection": (365.0, 0.988, None, None, (40.0, 60.0, 80.0), (50, 200)),
}
MIN_RECENCY, MIN_IMPORTANCE = 0.05, 5.0


def of_layer(value) -> Column:
    """A column of a layer's parameter."""
    out = None
    for name, settings in LAYERS.items():
        hit = F.col("layer") == name
        out = F.when(hit, F.lit(value(settings))) if out is None else out.when(hit, F.lit(value(settings)))
    return out


def compound(recency: Column, importance: Column) -> Column:
    return recency + F.least(importance, F.lit(100.0)) / 100


def insert(memories: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """New memories: importance drawn by a hash of seed and key with the layer's shares, recency 1, delta 0."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    low, high = of_layer(lambda s: s[5][0]), of_layer(lambda s: s[5][1])
    value = F.when(draw < low, of_layer(lambda s: s[4][0])).when(draw < high, of_layer(lambda s: s[4][1])).otherwise(of_layer(lambda s: s[4][2]))
    out = memories.withColumn("importance", value).withColumn("recency", F.lit(1.0)).withColumn("delta", F.lit(0).cast("long")).withColumn("access_counter", F.lit(0).cast("long"))
    return out.withColumn("compound", compound(F.col("recency"), F.col("importance")))


def decay(memories: DataFrame, steps: int = 1) -> DataFrame:
    """``steps`` days of decay in closed form."""
    aged = memories.withColumn("delta", F.col("delta") + steps)
    aged = aged.withColumn("recency", F.exp(-F.col("delta") / of_layer(lambda s: s[0]))).withColumn("importance", F.col("importance") * F.pow(of_layer(lambda s: s[1]), F.lit(float(steps))))
    return aged.withColumn("compound", compound(F.col("recency"), F.col("importance")))


def stale() -> Column:
    return (F.col("recency") < MIN_RECENCY) | (F.col("importance") < MIN_IMPORTANCE)


def cleanup(memories: DataFrame) -> DataFrame:
    return memories.where(~stale())


def removed(memories: DataFrame) -> DataFrame:
    return memories.where(stale()).select("id")


def jump(memories: DataFrame, rounds: int = 2) -> DataFrame:
    """Moves memories between layers: in each round short up, mid up or down, long down. Going up resets recency and delta; compound stays."""
    out = memories
    for _ in range(rounds):
        for name, below, above in (("short", None, "mid"), ("mid", "short", "long"), ("long", "mid", None)):
            _, _, up, down, _, _ = LAYERS[name]
            here = F.col("layer") == name
            rises = here & (F.col("importance") >= up) if up is not None else F.lit(False)
            falls = here & (F.col("importance") < down) if down is not None else F.lit(False)
            moved = F.when(rises, above).when(falls, below).otherwise(F.col("layer"))
            out = out.withColumns({"layer": moved, "recency": F.when(rises, 1.0).otherwise(F.col("recency")), "delta": F.when(rises, F.lit(0).cast("long")).otherwise(F.col("delta"))})
    return out


def step(memories: DataFrame) -> DataFrame:
    """A day's maintenance: decay, cleanup, jumps."""
    return jump(cleanup(decay(memories)))


def feedback(memories: DataFrame, given: DataFrame, gone: DataFrame) -> DataFrame:
    """Applies feedback (id, value, seq) in order: the counter changes by the value, importance by five times the new counter.

    With the counters c1..cn after each one, importance grows by 5 * (c1 + ... + cn), so only two sums per memory are
    needed. Ids in ``gone`` get none.
    """
    live = given.join(gone.select("id").distinct(), "id", "left_anti")
    later = F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc()))
    sums = live.withColumn("later", later).groupBy("id").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("later")).alias("weighted"), F.count("*").alias("n"))
    joined = memories.join(sums, "id", "left")
    n, total, weighted = (F.coalesce(c, F.lit(0)) for c in ("n", "total", "weighted"))
    out = joined.withColumn("importance", F.col("importance") + 5 * (n * F.col("access_counter") + weighted)).withColumn("access_counter", F.col("access_counter") + total)
    return out.withColumn("compound", F.when(F.col("n") > 0, compound(F.col("recency"), F.col("importance"))).otherwise(F.col("compound"))).drop("n", "total", "weighted")


def day(state: DataFrame, gone: DataFrame, arrived: DataFrame, given: DataFrame, legacy_removed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(state, ids that are removed now) after a day: new memories, feedback but for ids removed so far, then ``step``.

    Removed are the ids that the clean-up drops. With ``legacy_removed`` also those that change their layer, as the
    older behaviour had it, so that later feedback never reaches them although they are still there.
    """
    known = state.select("id", "symbol", "layer", "importance", "recency", "compound", "delta", "access_counter")
    grown = known.unionByName(insert(arrived.select("id", "symbol", "layer")).select(*known.columns))
    aged = decay(feedback(grown, given, gone))
    after, dropped = jump(cleanup(aged)), removed(aged)
    if legacy_removed:
        before = aged.select("id", F.col("layer").alias("_before"))
        dropped = dropped.union(after.join(before, "id").where("layer != _before").select("id"))
    return after.select(*known.columns), dropped.distinct()


def run_days(path: str, state: DataFrame, days: list[tuple[str, DataFrame, DataFrame]], legacy_removed: bool = False) -> DataFrame:
    """The state after ``days`` (name, new memories, feedback; names ascend), each kept under ``path`` with the ids removed on it.

    A day is complete when its removed ids are written, which is last. Called again, also with more days, it goes on
    after the last complete day, and the result is that of one run. Feedback of a day meets the ids removed before it.
    """
    spark, gone = state.sparkSession, state.select("id").limit(0)
    for name, arrived, given in days:
        kept, dropped = f"{path}/day={name}/state", f"{path}/day={name}/removed"
        if not complete(spark, dropped):
            after, removed_now = day(state, gone, arrived, given, legacy_removed)
            written(after, kept)
            written(removed_now, dropped)
        state = spark.read.schema("id long, symbol string, layer string, importance double, recency double, compound double, delta long, access_counter long").parquet(kept)
        gone = gone.union(spark.read.schema("id long").parquet(dropped))
    return state


def hybrid_query(memories: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = ("symbol",), stage2_order: str = "asc") -> DataFrame:
    """Retrieval of each query's key: the k most similar and k by compound score (the lowest first, or ``desc``), the k best of both by similarity + compound, distinct ids.

    queries: query_id, query and the keys. Each of the two choices keeps k rows per query in every task before its
    shuffle, so a key with many memories is not gathered.
    """
    known, asked = memories.withColumn("norm", V.norm(F.col("embedding"))), queries.withColumn("query_norm", V.norm(F.col("query")))
    similarity = V.cosine(F.col("query"), F.col("embedding"), F.col("query_norm"), F.col("norm"))
    joined = known.join(asked, list(keys)).select("query_id", *keys, "id", "compound", similarity.alias("similarity"))

    def first(copy: int, ahead: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(ahead, "id"))
        return joined.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("copy", F.lit(copy))

    compound = F.col("compound").asc() if stage2_order == "asc" else F.col("compound").desc()
    twice = first(1, F.col("similarity").desc()).unionByName(first(2, compound))
    merged = twice.withColumn("score", F.col("similarity") + F.col("compound"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").desc(), "copy"))
    return merged.withColumn("best", best).where(F.col("best") <= k).groupBy("query_id", *keys, "id").agg(F.max("score").alias("score"))


def search_as_of(queries: DataFrame, vectors: DataFrame, metadata: DataFrame, k: int, prefilter: bool = False) -> DataFrame:
    """Vector search behind a time fence (queries: query_id, query, as_of): the first k available of the 2k nearest; ``prefilter`` fences first."""
    if prefilter:
        return nearest(queries, vectors.join(metadata, "id"), k, fence=("as_of", "available_at"))
    hits = nearest(queries.select("query_id", "query"), vectors, 2 * k).join(metadata, "id").join(queries.select("query_id", "as_of"), "query_id")
    open_hits = hits.where(F.col("available_at") <= F.col("as_of"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return open_hits.withColumn("rank", again).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def newest(fences: DataFrame, metadata: DataFrame, k: int, seconds: int = 86_400) -> DataFrame:
    """(as_of, id, rank) of the k newest records (id, event_date, created_at, available_at) that are available at each ``as_of``."""
    found = segments.top_so_far(fences, metadata, "as_of", "available_at", (("event_date", True), ("created_at", True), ("id", False)), k, seconds)
    return found.select("as_of", "id", "rank")


def search_or_newest(queries: DataFrame, vectors: DataFrame, metadata: DataFrame, k: int) -> DataFrame:
    """``search_as_of``; a query none of whose 2k nearest has metadata gets the k newest records behind its fence, without a score."""
    known = nearest(queries.select("query_id", "query"), vectors, 2 * k).join(metadata.select("id"), "id", "left_semi")
    unmet = queries.join(known, "query_id", "left_anti").select("query_id", "as_of")
    others = unmet.join(newest(unmet, metadata, k), "as_of").select("query_id", "id", F.lit(None).cast("double").alias("score"), "rank")
    return search_as_of(queries, vectors, metadata.select("id", "available_at"), k).unionByName(others)


def references(found: DataFrame, memories: DataFrame, agents: DataFrame, preview: int = 160) -> DataFrame:
    """memory_id, layer, symbol, date, source_agent_id and the start of the text of what was found (symbol, layer, id) for each agent; placeholders (id -1) aren't referred to."""
    texts = memories.select("id", F.substring("text", 1, preview).alias("text_preview"))
    rows = found.where("id != -1").join(texts, "id").join(agents.select("agent_id", "symbol", "date"), "symbol")
    return rows.select(F.col("id").alias("memory_id"), "layer", "symbol", "date", F.col("agent_id").alias("source_agent_id"), "text_preview")


def share(routes: DataFrame, memories: DataFrame, parties: tuple[str, str] = ("source_symbol", "target_symbol")) -> DataFrame:
    """Memories sent along routes: the first top_k of the source's layer, as ids and text; what one party has had from the other before (the same ids in order) is marked deduped.

    ``parties`` are two columns of the routes, such as the source and target agents. A source's memories are ranked once
    for all its routes, and only the first of them, as many as the largest top_k, meet the routes.
    """
    rank = F.row_number().over(Window.partitionBy("symbol", "layer").orderBy(F.col("importance").desc(), "id"))
    source = memories.select("symbol", "layer", "id", "text", "importance").withColumn("rank", rank)
    source = source.where(F.col("rank") <= routes.agg(F.max("top_k")).scalar()).select(F.col("symbol").alias("source_symbol"), "layer", "id", "text", "rank")
    found = routes.join(source, ["source_symbol", "layer"]).where(F.col("rank") <= F.col("top_k"))
    sent = found.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("sent"))
    rows = routes.join(sent, "route_id", "left").withColumn("sent", F.coalesce("sent", F.array().cast("array<struct<rank:int,id:bigint,text:string>>")))
    lines = F.transform("sent", lambda x: F.concat(F.lit("- "), x["text"]))
    body = F.when(F.size("sent") > 0, F.array_join(lines, "\n")).otherwise("- No source memory returned.")
    head = F.format_string("Shared from %s to %s. Graph influence alpha=%.3f. Reason: %s", "source_symbol", "target_symbol", "alpha", "reason")
    rows = rows.withColumn("ids", F.transform("sent", lambda x: x["id"])).withColumn("text", F.concat(head, F.lit("\n"), body))
    again = F.row_number().over(Window.partitionBy(*parties, "ids").orderBy("date", "route_id")) > 1
    return rows.withColumn("deduped", again).select("route_id", "date", "source_symbol", "target_symbol", *(c for c in parties if c not in ("source_symbol", "target_symbol")), "ids", "text", "deduped")


def section(title: str, items: Column) -> Column:
    body = F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("None.")
    return F.concat(F.lit(f"{title}:\n"), body)


#: The sentences of the sign of the last days' cumulative return.
MOMENTUM = {-1: "The cumulative return of past 3 days for this stock is negative.", 0: "The cumulative return of past 3 days for this stock is zero.", 1: "The cumulative return of past 3 days for this stock is positive."}


def momentum_sentence(momentum: Column) -> Column:
    """What is said of a momentum; nothing where there is none."""
    return F.coalesce(*(F.when(momentum == sign, F.lit(text)) for sign, text in MOMENTUM.items()), F.lit(""))


def with_placeholders(groups: DataFrame, memories: DataFrame, k: int = 3) -> DataFrame:
    """symbol, layer, ids and texts of the k most important memories of each symbol in ``groups`` and layer: two placeholders (id -1) of an empty layer, a single memory twice.

    Memories are ranked to k before they are gathered; ties go to the smaller id.
    """
    layers = groups.select("symbol").distinct().withColumn("layer", F.explode(F.array(*map(F.lit, LAYERS))))
    rank = F.row_number().over(Window.partitionBy("symbol", "layer").orderBy(F.col("importance").desc(), "id"))
    best = memories.select("symbol", "layer", "id", "text", rank.alias("rank")).where(F.col("rank") <= k)
    found = best.groupBy("symbol", "layer").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("items"))
    rows = layers.join(found, ["symbol", "layer"], "left")
    out = []
    for column, missing in (("id", F.lit(-1).cast("long")), ("text", F.concat(F.lit("No "), "layer", F.lit("-term information.")))):
        items = F.col(f"items.{column}")
        out.append(F.when(F.coalesce(F.size("items"), F.lit(0)) <= 0, F.array(missing, missing)).when(F.size("items") == 1, F.concat(items, items)).otherwise(items).alias(f"{column}s"))
    return rows.select("symbol", "layer", *out)


def structured(title: str, fields: dict[str, Column]) -> Column:
    """A section of named values as indented JSON, names in order; texts are given quoted. Null if any value is."""
    lines = [F.concat(F.lit(f'  "{name}": '), value) for name, value in sorted(fields.items())]
    return F.concat(F.lit(f"{title}:\n{{\n"), F.concat(*(x for line in lines[:-1] for x in (line, F.lit(",\n"))), lines[-1]), F.lit("\n}"))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def context(agents: DataFrame, memories: DataFrame, per_layer: int, shared: DataFrame | None = None) -> DataFrame:
    """Context text of each agent (agent_id, symbol, date): the top memories of the four layers and shared items in fixed sections.

    agents may have columns ``latest_reason`` and sections ``shadow_state`` and ``psychology_state`` (see ``structured``);
    what is null is left out. shared: (target_agent_id, position, source_agent_id, source_symbol, alpha as text, text).
    """
    rank = F.row_number().over(Window.partitionBy("symbol", "layer").orderBy(F.col("importance").desc(), "id"))
    top = memories.withColumn("rank", rank).where(F.col("rank") <= per_layer)
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == name, F.struct("rank", "text")))), lambda x: x["text"]).alias(name) for name in LAYERS]
    rows = agents.join(top.groupBy("symbol").agg(*lists), "symbol", "left")
    empty = F.array().cast("array<string>")
    items = empty
    if shared is not None:
        line = F.concat(F.lit("From "), "source_agent_id", F.lit(" ("), "source_symbol", F.lit(") alpha="), "alpha", F.lit(": "), "text").alias("line")
        sent = shared.groupBy(F.col("target_agent_id").alias("agent_id")).agg(F.array_sort(F.collect_list(F.struct("position", line))).alias("sent"))
        rows, items = rows.join(sent, "agent_id", "left"), F.coalesce(F.transform("sent", lambda x: x["line"]), empty)
    has = lambda name: [F.col(name)] if name in agents.columns else []
    heads = [F.concat(F.lit("Agent: "), "agent_id"), F.concat(F.lit("Symbol: "), "symbol"), F.concat(F.lit("Date: "), F.col("date").cast("string"))]
    heads += [F.concat(F.lit("Latest decision reason:\n"), x) for x in has("latest_reason")]
    sections = [section(f"{name.capitalize()} memory", F.coalesce(name, empty)) for name in LAYERS]
    text = F.concat_ws("\n\n", *heads, *sections, section("Shared context", items), *has("shadow_state"), *has("psychology_state"))
    return rows.select("agent_id", "symbol", "date", text.alias("context"))


def live_context(shared: DataFrame, today: Column) -> DataFrame:
    """Shared context that hasn't expired; without a time to live or a creation date it never does."""
    return shared.where(F.col("ttl_days").isNull() | F.col("created_at").isNull() | (today <= F.date_add("created_at", F.col("ttl_days"))))


def pack_tokens(texts: DataFrame, budget: int, keys: tuple[str, ...], order: str) -> DataFrame:
    """Takes texts in order while their words fit the budget, cuts the first that doesn't, and stops."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = texts.withColumn("words", words).withColumn("n_tokens", F.size("words").cast("long"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n_tokens"), budget - before)).cast("long")).where("taken > 0")
    text = F.when(F.col("taken") < F.col("n_tokens"), F.array_join(F.slice("words", 1, F.col("taken").cast("int")), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("words")
