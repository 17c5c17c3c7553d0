"""Correlation graphs: edges, attention, scores, node features and memory routes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


#: Symbols of a block, dates that a task sums before it hands on, and blocks of pairs that it keeps sums of.
SYMBOLS, SUMS = 256, 64
PAIR_SUMS = "row int, col int, sums binary"


def pair_sums(numbered: DataFrame, blocks: int) -> DataFrame:
    """Sums over common dates for each pair of symbol blocks (row <= col): n, x, y, xx, yy, xy as matrices of SYMBOLS x SYMBOLS.

    numbered: (date, symbol block, place in the block, ret). A date's returns of a block are one row of a matrix, which
    meets those of the blocks after it; so a pair of blocks and dates is three products of matrices, and symbols aren't
    joined one by one. A task sums over its dates before the shuffle.
    """
    packed = numbered.groupBy("date", "block").agg(F.collect_list(F.struct("place", "ret")).alias("cells"))  # at most SYMBOLS
    # a block's row goes to each pair of blocks that it is part of: pair (i, j) as the left for j >= i, as the right for i < j
    pairs = F.flatten(F.array(F.transform(F.sequence(F.col("block"), F.lit(blocks - 1)), lambda j: F.struct(F.col("block").alias("row"), j.alias("col"), F.lit(0).alias("side"))), F.filter(F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("row"), F.col("block").alias("col"), F.lit(1).alias("side"))), lambda x: x["row"] < x["col"])))
    dealt = packed.select("date", "cells", F.explode(pairs).alias("pair"))
    met = dealt.groupBy("date", "pair.row", "pair.col").agg(F.max_by("cells", "pair.side").alias("right"), F.min_by("cells", "pair.side").alias("left"), F.count("*").alias("sides"))
    both = met.where((F.col("row") == F.col("col")) | (F.col("sides") == 2)).select("row", "col", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            left, right = _matrix(batch["left"], SYMBOLS), _matrix(batch["right"], SYMBOLS)
            keys = np.stack([batch["row"].to_numpy(), batch["col"].to_numpy()], 1)
            for row, col in np.unique(keys, axis=0).tolist():
                own = np.flatnonzero((keys[:, 0] == row) & (keys[:, 1] == col))
                x, y = left[own], right[own]
                a, b = ~np.isnan(x), ~np.isnan(y)
                x, y = np.where(a, x, 0.0), np.where(b, y, 0.0)
                a, b = a.astype(float), b.astype(float)
                if (row, col) not in held and len(held) >= SUMS:
                    yield rows(held)
                sums = held.setdefault((row, col), np.zeros((6, SYMBOLS, SYMBOLS)))
                sums += np.stack([a.T @ b, x.T @ b, a.T @ y, (x * x).T @ b, a.T @ (y * y), x.T @ y])
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        keys, found = list(held), [x.tobytes() for x in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(found, pa.binary())], names=["row", "col", "sums"])

    return both.mapInArrow(run, PAIR_SUMS)


def _matrix(cells: pa.Array, size: int) -> np.ndarray:
    """Rows of returns by place; NaN where a symbol has none."""
    many = pc.list_value_length(cells).to_numpy().astype(np.int64)
    flat = cells.flatten()
    out = np.full((len(cells), size), np.nan)
    out[np.repeat(np.arange(len(many)), many), flat.field("place").to_numpy()] = flat.field("ret").to_numpy()
    return out


def correlation_edges(rets: DataFrame, min_abs: float = 0.2, default: float = 0.0) -> DataFrame:
    """(target, source, weight) of all symbol pairs with themselves: Pearson correlation of returns on common dates.

    Under two common finite pairs, or without variance, the default weight; under ``min_abs`` 0; itself 1. Symbols are
    numbered and cut into blocks; pairs of blocks, the second not before the first, are summed by ``pair_sums`` and
    mirrored. rets: (date, symbol, ret), a symbol once a date. Symbols without any finite return have default weights.
    """
    spark = rets.sparkSession
    rets = written(rets.where("symbol is not null").select("date", "symbol", "ret"))  # read twice
    names = rets.select("symbol").distinct()
    ordered = names.repartitionByRange("symbol").sortWithinPartitions("symbol").select("symbol", F.monotonically_increasing_id().alias("at"))
    # consecutive numbers: those of a partition follow the sizes of the ones before it
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    numbered = written(ordered.withColumn("part", F.shiftright("at", 33)).join(before, "part").select("symbol", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number")))
    blocks = -(-numbered.count() // SYMBOLS)
    if not blocks:
        return spark.createDataFrame([], "target string, source string, weight double")
    place = numbered.select("symbol", (F.col("number") / SYMBOLS).cast("int").alias("block"), (F.col("number") % SYMBOLS).cast("int").alias("place"))
    finite = rets.where("date is not null and ret is not null and not isnan(ret) and abs(ret) < double('infinity')")
    sums = pair_sums(finite.join(place, "symbol"), blocks)
    names = place.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "symbol"))).alias("names"))  # at most SYMBOLS
    frame = names.select(F.col("block").alias("row"), F.transform("names", lambda x: x["symbol"]).alias("targets"))
    other = frame.select(F.col("row").alias("col"), F.col("targets").alias("sources"))
    # every pair of blocks has a row, also without a common date
    every = frame.withColumn("col", F.explode(F.sequence(F.col("row"), F.lit(blocks - 1)))).join(other, "col").select("row", "col", "targets", "sources", F.lit(None).cast("binary").alias("sums"))
    merged = every.unionByName(sums.select("row", "col", F.lit(None).cast("array<string>").alias("targets"), F.lit(None).cast("array<string>").alias("sources"), "sums"))

    def weights(key: tuple, table: pa.Table) -> pa.Table:
        total, targets, sources = np.zeros((6, SYMBOLS, SYMBOLS)), [], []
        for batch in table.to_batches():
            for given, first, second in zip(batch["sums"], batch["targets"], batch["sources"], strict=True):
                if given.is_valid:
                    total += np.frombuffer(given.as_buffer()).reshape(6, SYMBOLS, SYMBOLS)
                else:
                    targets, sources = first.as_py(), second.as_py()
        n, x, y, xx, yy, xy = (m[: len(targets), : len(sources)] for m in total)
        with np.errstate(all="ignore"):
            spread = np.sqrt(np.maximum(xx - x * x / n, 0)) * np.sqrt(np.maximum(yy - y * y / n, 0))
            r = np.clip((xy - x * y / n) / spread, -1, 1)
        known = (n >= 2) & (spread > 1e-15)
        weight = np.where(known, np.where(np.abs(r) >= min_abs, r, 0.0), min(1.0, max(-1.0, default)))
        i, j = np.indices(weight.shape)
        upper = (i < j) if key[0].as_py() == key[1].as_py() else np.ones(weight.shape, bool)
        a, b, w = np.array(targets, object)[i[upper]], np.array(sources, object)[j[upper]], weight[upper]
        own = np.array(targets if key[0].as_py() == key[1].as_py() else [], object)
        return pa.table({"target": pa.array(np.concatenate([a, b, own]), pa.string()), "source": pa.array(np.concatenate([b, a, own]), pa.string()), "weight": np.concatenate([w, w, np.ones(len(own))])})

    return merged.groupBy("row", "col").applyInArrow(weights, "target string, source string, weight double")


def attention(edges: DataFrame, use_abs: bool = True, normalize: bool = True) -> DataFrame:
    """Adds ``attention``: |weight| (or its positive part), 0 to itself, scaled to 1 in sum for each target that has any."""
    raw = F.when(F.col("target") == F.col("source"), 0.0).otherwise(F.abs("weight") if use_abs else F.greatest("weight", F.lit(0.0)))
    out = edges.withColumn("attention", raw)
    if not normalize:
        return out
    return out.withColumn("_total", F.sum("attention").over(Window.partitionBy("target"))).withColumn("attention", F.when(F.col("_total") > 0, F.col("attention") / F.col("_total")).otherwise(F.col("attention"))).drop("_total")


def graph_scores(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """Each target's attention-weighted sum of the sources' action signals (missing: 0), within -1 and 1."""
    joined = edges.where("target != source").join(signals.select(F.col("symbol").alias("source"), "action_signal"), "source", "left")
    return joined.groupBy("target").agg(clamp(F.sum(F.col("attention") * F.coalesce("action_signal", F.lit(0)))).alias("score"))


def l2_norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def text_norms(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean length and number of each symbol's text vectors."""
    return features.groupBy("symbol").agg(F.avg(l2_norm(vector)).alias("text_norm"), F.count("*").alias("num_text_features"))


def node_features(quant: DataFrame, shadows: DataFrame, texts: DataFrame) -> DataFrame:
    """Quant rows with the symbol's shadow metrics and text statistics, 0 where there are none."""
    joined = quant.join(shadows, "symbol", "left").join(texts, "symbol", "left")
    names = {"shadow_roi": "roi", "shadow_drawdown": "drawdown", "shadow_sharpe": "sharpe", "shadow_win_rate": "win_rate"}
    filled = [F.coalesce(c, F.lit(0.0)).alias(k) for k, c in names.items()]
    return joined.select(*quant.columns, *filled, F.coalesce("text_norm", F.lit(0.0)).alias("text_norm"), F.coalesce("num_text_features", F.lit(0)).cast("long").alias("num_text_features"))


def share_routes(edges: DataFrame, agents: DataFrame, threshold: float = 0.5, top_k: int = 3, layer: str = "short") -> DataFrame:
    """Routes from source to target agents where attention reaches the threshold; symbols without an agent have none."""
    target = agents.select(F.col("symbol").alias("target"), F.col("agent_id").alias("target_agent_id"))
    source = agents.select(F.col("symbol").alias("source"), F.col("agent_id").alias("source_agent_id"))
    strong = edges.where((F.col("target") != F.col("source")) & (F.col("attention") >= threshold))
    rows = strong.join(target, "target").join(source, "source")
    reason = F.format_string("%s influences %s through graph attention alpha=%.4f.", "source", "target", "attention")
    asked = F.format_string("%s risk and market memory relevant to %s", "source", "target")
    return rows.select("source_agent_id", "target_agent_id", F.col("source").alias("source_symbol"), F.col("target").alias("target_symbol"), F.col("attention").alias("alpha"), reason.alias("reason"), F.lit(layer).alias("layer"), F.lit(top_k).alias("top_k"), asked.alias("query_text"), F.lit(1).alias("ttl_days")).orderBy(F.col("alpha").desc(), "source_symbol", "target_symbol")
