"""Hard negatives of anchors: rows of another label that score just below the anchor's positives.

Rows are packed into blocks, each row with its norm and its angles to a few reference directions. By the triangle
inequality on the sphere, the angle between two rows lies between the largest difference and the smallest sum of their
angles to a reference. The cosines of both, times the norms, bound the score, with a margin above all rounding. A block
is met only if the bounds over its rows reach the window that an anchor still looks for, and within a block only rows
whose own bounds do get their integer score. The anchors are a stated set of queries: blocks of anchors meet the row
blocks of every part of the table, and a part's task keeps a few rows for each anchor, merged by score afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, written

#: Reference directions (this many rows are sent to the driver), rows of a block, anchors of a block.
REFERENCES, ROWS, ANCHORS = 8, 1024, 256
#: Row blocks of a part, which gets a copy of all anchors, while there are not more parts than shuffle partitions.
PART = 4
#: Rows that wait in a task to be put in order of label and angles, and anchor blocks that keep rows in a task.
WAITING, HELD = 32_768, 64
#: Radians that bounds of angles are wider by, and the share of the norms that bounds of scores are.
SLACK = 1e-6
EXACT = float(1 << 52)

ROW_SCHEMA = "uid long, vec_id long, label long, vector array<double>, windows array<struct<positive_id: long, positive_score: long>>"
BLOCK = ["uids", "ids", "labels", "vectors", "norms", "angles"]
BLOCK_SCHEMA = "n int, dim int, " + ", ".join(f"{x} binary" for x in BLOCK) + ", low_label long, high_label long, window_ids binary, window_scores binary, window_counts binary"
FOUND_SCHEMA = "uid long, anchor_id long, place int, found_id long, score long"
NEVER = np.iinfo(np.int64).min


def prepare(vectors: DataFrame, label: Column) -> DataFrame:
    """Rows that take part: uid, vec_id, label, vector (floor of 256 times each component, as whole doubles)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    scaled = lambda x: 256 * x.cast("double")
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))  # larger ones are whole
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"), F.lit(None).cast("array<struct<positive_id: long, positive_score: long>>").alias("windows"))


def references(rows: DataFrame) -> np.ndarray:
    """Unit vectors of the REFERENCES rows whose ids have the lowest hashes."""
    some = [r.vector for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(REFERENCES).select("vector").collect()]
    some = [np.array(x) for x in some if x and 0 < np.linalg.norm(x) < math.inf]
    out = np.zeros((len(some), max(map(len, some), default=0)))
    for k, x in enumerate(some):
        out[k, : len(x)] = x / np.linalg.norm(x)
    return out


def angles(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles (rows x references); a row without length may have any, one too long for doubles has none (nan)."""
    d = min(vectors.shape[1], directions.shape[1])
    with np.errstate(all="ignore"):
        found = np.arccos(np.clip(vectors[:, :d] @ directions[:, :d].T / norms[:, None], -1, 1))
    found[norms == 0] = 0
    return found


def pack(rows: DataFrame, directions: np.ndarray, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows, alike in label and angles where a task reads many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= WAITING:
                yield blocks(pa.Table.from_batches(waiting))
                waiting, n = [], 0
        if n:
            yield blocks(pa.Table.from_batches(waiting))

    def blocks(table: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(table["vector"].combine_chunks())
        norms = np.sqrt((vectors * vectors).sum(1))
        turned = angles(vectors, norms, directions)
        label = table["label"].to_numpy()
        near = np.argmin(np.nan_to_num(turned, nan=9.0), 1) if turned.shape[1] else np.zeros(len(label), int)
        nearness = turned[np.arange(len(near)), near] if turned.shape[1] else norms
        order = np.lexsort((nearness, near, label))
        windows = table["windows"].combine_chunks()
        begins, many, flat = windows.offsets.to_numpy(), pc.fill_null(pc.list_value_length(windows), 0).to_numpy().astype(np.int64), windows.values
        out = []
        for at in range(0, len(order), size):
            own = order[at : at + size]
            inside = np.repeat(begins[own] - (np.cumsum(many[own]) - many[own]), many[own]) + np.arange(many[own].sum())
            ids, scores = (x.to_numpy(zero_copy_only=False)[inside].astype(np.int64).tobytes() if len(inside) else b"" for x in (flat.field(0), flat.field(1)))
            arrays = table["uid"].to_numpy()[own], table["vec_id"].to_numpy()[own], label[own], vectors[own], norms[own], turned[own]
            out.append((len(own), vectors.shape[1], *(np.ascontiguousarray(x).tobytes() for x in arrays), int(label[own].min()), int(label[own].max()), ids, scores, many[own].astype(np.int64).tobytes()))
        fields = [f.split() for f in BLOCK_SCHEMA.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], names=[name for name, _ in fields])

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length; missing components are 0."""
    many = pc.list_value_length(lists).to_numpy().astype(np.int64)
    out = np.zeros((len(lists), int(many.max()) if len(many) else 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(many)), many), np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
    return out


def unpack(blocks: DataFrame, anchor_every: int) -> DataFrame:
    """The rows of blocks whose vec_id is divisible by ``anchor_every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                own = np.flatnonzero(b.ids % anchor_every == 0)
                columns = [pa.array(b.uids[own]), pa.array(b.ids[own]), pa.array(b.labels[own]), pa.array(list(b.vectors[own]), pa.list_(pa.float64())), pa.nulls(len(own), pa.list_(pa.struct([("positive_id", pa.int64()), ("positive_score", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "vec_id", "label", "vector", "windows"])

    return blocks.mapInArrow(run, ROW_SCHEMA)


class Block:
    def __init__(self, row: dict):
        n, whole = row["n"], lambda x: np.frombuffer(row[x], np.int64)
        self.uids, self.ids, self.labels = whole("uids"), whole("ids"), whole("labels")
        self.vectors, self.norms = np.frombuffer(row["vectors"]).reshape(n, -1), np.frombuffer(row["norms"])
        self.angles = np.frombuffer(row["angles"]).reshape(n, -1)
        with np.errstate(all="ignore"):
            self.low, self.high = np.fmin.reduce(self.angles, 0), np.fmax.reduce(self.angles, 0)
        self.bounded = not np.isnan(self.angles).any()
        self.most, self.least = (self.norms.max(), self.norms.min()) if n else (0.0, 0.0)
        self.window_ids, self.window_scores, self.window_counts = whole("window_ids"), whole("window_scores"), whole("window_counts")


def _scores(near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score for angles between near and far and products of norms between least and most."""
    up, down = np.cos(np.clip(near - SLACK, 0, math.pi)), np.cos(np.clip(far + SLACK, 0, math.pi))
    margin = SLACK * most + 1
    return np.where(down >= 0, least, most) * down - margin, np.where(up >= 0, most, least) * up + margin


def block_bounds(a: Block, r: Block) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of each anchor of ``a`` with any row of ``r``."""
    if not (r.bounded and a.bounded and a.angles.shape[1]):
        return np.full(len(a.ids), -math.inf), np.full(len(a.ids), math.inf)
    near = np.maximum(np.maximum(a.angles - r.high, r.low - a.angles), 0).max(1)
    least, most = a.angles + r.low, a.angles + r.high
    far = np.where(most <= math.pi, most, np.where(least >= math.pi, 2 * math.pi - least, math.pi)).min(1)
    return _scores(near, far, a.norms * r.least, a.norms * r.most)


def row_bounds(a: Block, some: np.ndarray, r: Block) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of each pair of the anchors ``some`` and the rows of ``r``."""
    shape = len(some), len(r.ids)
    if not (r.bounded and a.bounded and a.angles.shape[1]):
        return np.full(shape, -math.inf), np.full(shape, math.inf)
    near, far = np.zeros(shape), np.full(shape, math.pi)
    for k in range(a.angles.shape[1]):
        x, y = a.angles[some, k][:, None], r.angles[:, k][None, :]
        np.maximum(near, np.abs(x - y), out=near)
        total = x + y
        np.minimum(far, np.minimum(total, 2 * math.pi - total), out=far)
    product = a.norms[some][:, None] * r.norms[None, :]
    return _scores(near, far, product, product)


def inner(a: np.ndarray, r: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole vectors; sums that doubles can't hold are taken as Python integers."""
    d = min(a.shape[1], r.shape[1])
    if largest < EXACT:
        return (a[:, :d] @ r[:, :d].T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m[:, :d].tolist()], object).reshape(len(m), d)
    found = whole(a) @ whole(r).T if d else np.zeros((len(a), len(r)), object)
    return found.astype(np.int64)  # an OverflowError where a score is no long


class Best:
    """The first rows of each place (anchor, or anchor and positive) so far."""

    def __init__(self, places: int, keep: int):
        self.keep = keep
        self.place, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.limit = np.full(places, NEVER)  # a lower score can't enter any more

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        place, score, ids = np.append(self.place, place), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        last = rank == self.keep - 1
        self.limit[place[last]] = score[last]
        self.place, self.score, self.id = place[rank < self.keep], score[rank < self.keep], ids[rank < self.keep]


def met(anchors: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """Each anchor block with all row blocks, part by part.

    Spark would take the anchors, a copy for each part, for as small as one copy's file and send them through the driver.
    """
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("uids"), F.lit(parts)).cast("int"))
    a = F.struct(F.xxhash64("uids").alias("key"), *(x.split()[0] for x in BLOCK_SCHEMA.split(", "))).alias("a")
    r = F.struct(*(x.split()[0] for x in BLOCK_SCHEMA.split(", "))).alias("r")
    return left.select("part", a).join(right.select("part", r).hint("merge"), "part").select("a", "r")


def search(anchors: DataFrame, blocks: DataFrame, parts: int, keep: int, negatives: tuple[int, int] | None) -> DataFrame:
    """For each part and anchor the first ``keep`` rows: of its label (the anchor itself left out), or with
    ``negatives`` (percent of a positive's score, from and to) of other labels for each of its windows.

    found: uid and anchor_id of the anchor, place (number of the positive, or 0), found_id, score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, Best]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                a_row, r_row = batch["a"][k], batch["r"][k]
                key = a_row["key"].as_py()
                if key not in held:
                    if len(held) >= HELD:
                        yield rows(held)
                    a = Block(a_row.as_py())
                    held[key] = a, Best(len(a.ids) if negatives is None else len(a.window_scores), keep)
                meet(*held[key], Block(r_row.as_py()))
        yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        out = []
        for a, best in held.values():
            owner = np.arange(len(a.ids)) if negatives is None else np.repeat(np.arange(len(a.ids)), a.window_counts)
            first = np.cumsum(a.window_counts) - a.window_counts
            number = np.zeros(len(best.place), np.int64) if negatives is None else best.place - first[owner[best.place]]
            out.append((a.uids[owner[best.place]], a.ids[owner[best.place]], number, best.id, best.score))
        held.clear()
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in FOUND_SCHEMA.split(", ")])

    def meet(a: Block, best: Best, r: Block) -> None:
        if negatives is None:
            owner = np.arange(len(a.ids))
            from_, to = best.limit, np.full(len(owner), np.iinfo(np.int64).max)
        else:
            owner = np.repeat(np.arange(len(a.ids)), a.window_counts)
            whole = [(-(-negatives[0] * p // 100), negatives[1] * p // 100) for p in a.window_scores.tolist()]
            from_, to = (np.array([w[k] for w in whole], np.int64) for k in (0, 1))
            from_ = np.maximum(from_, best.limit)
        low, high = block_bounds(a, r)
        ceiling = np.full(len(owner), math.inf) if negatives is None else to.astype(float)
        open_ = np.flatnonzero((high[owner] >= from_) & (low[owner] <= ceiling) & (from_ <= to))
        if not len(open_):
            return
        some, at = np.unique(owner[open_], return_inverse=True)
        lowest, highest = np.full(len(some), math.inf), np.full(len(some), -math.inf)
        np.minimum.at(lowest, at, from_[open_].astype(float))
        np.maximum.at(highest, at, ceiling[open_])
        low, high = row_bounds(a, some, r)
        like = a.labels[some][:, None] == r.labels[None, :]
        wanted = (high >= lowest[:, None]) & (low <= highest[:, None]) & (like & (a.uids[some][:, None] != r.uids[None, :]) if negatives is None else ~like)
        which, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(which) or not len(cols):
            return
        score = inner(a.vectors[some[which]], r.vectors[cols], float((a.norms[some[which]].max() * r.norms[cols].max())))
        wanted = wanted[np.ix_(which, cols)]
        line = np.full(len(a.ids), -1)
        line[some[which]] = np.arange(len(which))
        open_ = open_[line[owner[open_]] >= 0]
        lines = line[owner[open_]]
        hit = wanted[lines] & (score[lines] >= from_[open_][:, None]) & (score[lines] <= to[open_][:, None])
        place, col = np.nonzero(hit)
        if len(place):
            best.add(open_[place], score[lines][place, col], r.ids[cols[col]])

    return met(anchors, blocks, parts).mapInArrow(run, FOUND_SCHEMA)


def first(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each anchor and place, by score and then id, with their ``rank``."""
    order = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, label: Column | None = None, anchor_every: int = 50, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by ``anchor_every``. Scores are inner products of the vectors' floored
    256-fold components, exact, and an error where one is no 64-bit integer. Rows with a null label or vector, a null or
    non-finite component, or no vec_id take no part. Vectors of unequal length are compared with zeros at the end of the
    shorter; an empty vector has score 0 with all. Ties go to the smaller vec_id. Rows that repeat a vec_id are rows of
    their own: an anchor only leaves out itself, and each of them is an anchor. Anchors without positives or without
    negatives in the window have no rows; an empty table has none. Columns of other names aren't read.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = written(prepare(vectors, F.col("label") if label is None else label))
    directions = references(rows)
    blocks = written(pack(rows.repartitionByRange("label", "vec_id"), directions, ROWS))
    anchors = written(unpack(blocks, anchor_every))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks.count() / PART)))
    few = max(1, math.ceil(anchors.count() / ANCHORS))
    asked = pack(anchors.repartition(few), directions, ANCHORS)
    positive = first(search(asked, blocks, parts, positives, None), positives)
    windows = positive.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "found_id", "score"))).alias("found"))  # at most ``positives``
    windows = windows.select("uid", F.transform("found", lambda x: F.struct(x["found_id"].alias("positive_id"), x["score"].alias("positive_score"))).alias("windows"))
    windowed = written(anchors.drop("windows").join(windows.hint("merge"), "uid").select(*(x.split()[0] for x in ROW_SCHEMA.split(", ")[:4]), "windows"))
    asked = pack(windowed.repartition(few), directions, ANCHORS)
    chosen = first(search(asked, blocks, parts, negatives, percent), negatives)
    named = chosen.join(windowed.select("uid", "windows").hint("merge"), "uid")
    return named.select("anchor_id", F.col("windows")[F.col("place")]["positive_id"].alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("windows")[F.col("place")]["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"))
