"""Exact nearest vectors by products of matrix blocks.

Queries and vectors are packed into blocks by the tasks that read them. Blocks of queries are dealt into lots that a task
can hold; a lot goes to every part of the vectors, where its blocks come first and then meet the part's blocks one by one,
keeping k rows for each query. So the vectors are read once for each lot, and a task holds a lot and one block. A block is skipped for the queries that its bound rules out: by the angle to its middle
direction for the cosine, by its lengths for the distance. Matrix products choose candidates with a margin; their scores
are then summed component by component, in the same order for every pair, so equal vectors tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of queries, and blocks of queries in a lot, about.
VECTORS, QUERIES, HELD = 2048, 512, 64
#: Pairs whose components are summed at once, and the share of the largest score that products may be off.
PAIRS, MARGIN = 100_000, 1e-9
FIELDS = "ids vectors norms keys times"
BLOCK = "n int, " + ", ".join(f"{x} binary" for x in FIELDS.split())
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def moment(name: str, kind: str, missing: int) -> Column:
    """A time or number as a long that sorts alike."""
    at = F.unix_date(name) if kind == "date" else F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name)
    return F.coalesce(at.cast("long"), F.lit(missing))


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (id, vector, key, time); shorter vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = part["vector"].to_pylist()
                matrix = np.zeros((len(lists), max(map(len, lists))))
                for i, x in enumerate(lists):
                    matrix[i, : len(x)] = x
                columns = [pa.array([len(lists)], pa.int32())]
                for values in (part["id"].to_numpy(), matrix, np.sqrt((matrix * matrix).sum(1)), part["key"].to_numpy(), part["time"].to_numpy()):
                    columns.append(pa.array([np.ascontiguousarray(values).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["n", *FIELDS.split()])

    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))).mapInArrow(run, BLOCK)


class Block:
    _cone = None

    def __init__(self, row: dict):
        self.ids, self.keys, self.times = (np.frombuffer(row[x], np.int64) for x in ("ids", "keys", "times"))
        self.vectors, self.norms = np.frombuffer(row["vectors"]).reshape(row["n"], -1), np.frombuffer(row["norms"])
        with np.errstate(all="ignore"):
            self.unit = np.where(self.norms[:, None] > 0, self.vectors / self.norms[:, None], 0.0)

    def cone(self) -> tuple[np.ndarray, float]:
        """The middle direction and the widest angle to it; a row without length has cosine 0 with all, so no bound."""
        if self._cone is None:
            self._cone = self._bound()
        return self._cone

    def _bound(self) -> tuple[np.ndarray, float]:
        middle = self.unit.sum(0)
        length = np.linalg.norm(middle)
        if not length > 0 or not (self.norms > 0).all():
            return np.zeros(self.vectors.shape[1]), np.pi
        middle = middle / length
        return middle, float(np.arccos(np.clip(self.unit @ middle, -1, 1)).max())


class Nearest:
    """The k best rows of each query of a block so far; larger scores are better."""

    def __init__(self, queries: Block, k: int, metric: str):
        self.q, self.k, self.metric = queries, k, metric
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.limit = np.full(len(queries.ids), -np.inf)

    def highest(self, v: Block) -> np.ndarray:
        """The most that each query can score with a row of the block."""
        if self.metric == "cosine":
            middle, widest = v.cone()
            d = min(len(middle), self.q.unit.shape[1])
            between = np.arccos(np.clip(self.q.unit[:, :d] @ middle[:d], -1, 1))
            return np.where(self.q.norms > 0, np.cos(np.maximum(between - widest - 1e-7, 0)), 0.0) + MARGIN
        gap = np.maximum(np.maximum(self.q.norms - v.norms.max(), v.norms.min() - self.q.norms), 0)
        return -(gap**2) * (1 - 1e-7) + MARGIN

    def exact(self, rows: np.ndarray, v: Block, cols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        width = max(self.q.vectors.shape[1], v.vectors.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        for at in range(0, len(rows), PAIRS):
            i, j = rows[at : at + PAIRS], cols[at : at + PAIRS]
            a, b = wide(self.q.vectors[i]), wide(v.vectors[j])
            if self.metric == "cosine":
                lengths = self.q.norms[i] * v.norms[j]
                out[at : at + PAIRS] = np.where(lengths > 0, (a * b).sum(1) / np.where(lengths > 0, lengths, 1.0), 0.0)
            else:
                out[at : at + PAIRS] = -((a - b) ** 2).sum(1)
        return out

    def meet(self, v: Block, same: bool, fence: bool) -> None:
        some = np.flatnonzero(self.highest(v) >= self.limit)
        if not len(some):
            return
        d = min(self.q.vectors.shape[1], v.vectors.shape[1])
        if self.metric == "cosine":
            near, scale = self.q.unit[some, :d] @ v.unit[:, :d].T, 1.0
        else:
            near = 2 * (self.q.vectors[some, :d] @ v.vectors[:, :d].T) - self.q.norms[some][:, None] ** 2 - v.norms[None, :] ** 2
            scale = 1 + float(self.q.norms[some].max() + v.norms.max()) ** 2
        if same:
            near[self.q.keys[some][:, None] != v.keys[None, :]] = -np.inf
        if fence:
            near[(self.q.times[some][:, None] < v.times[None, :]) | (v.times == LAST)[None, :]] = -np.inf
        last = max(0, near.shape[1] - self.k)
        floor = np.maximum(self.limit[some], np.partition(near, last, axis=1)[:, last]) - MARGIN * scale
        rows, cols = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        rows = some[rows]
        row, score, ids = np.append(self.row, rows), np.append(self.score, self.exact(rows, v, cols)), np.append(self.id, v.ids[cols])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        full = rank == self.k - 1
        self.limit[row[full]] = score[full]
        self.row, self.score, self.id = row[rank < self.k], score[rank < self.k], ids[rank < self.k]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", same: tuple[str, ...] = (), fence: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest vectors of every query: by ``cosine`` (0 with a zero vector), or by squared distance (``l2``).

    queries: query_id, query, and the columns of ``same``, which must be equal; vectors: id, embedding, and those. Ids are
    whole numbers. ``fence`` names a column of the queries and one of the vectors, which must not be later; a missing time
    is never met. Ties go to the smaller id. Null ids and
    vectors, and those with a null or NaN component, take no part; shorter vectors end in zeros.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(*same) if same else F.lit(0).cast("long")
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    asked, open_ = (moment(fence[0], kinds[fence[0]], FIRST), moment(fence[1], kinds[fence[1]], LAST)) if fence else (F.lit(0).cast("long"), F.lit(0).cast("long"))
    left = pack(queries.select(F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<double>").alias("vector"), key.alias("key"), asked.alias("time")).repartition(max(1, parts // 8)), QUERIES)
    right = pack(vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), key.alias("key"), open_.alias("time")), VECTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch["part"][i].as_py(), batch["lot"][i].as_py()
                if place != at:
                    yield rows(held)
                    held, at = [], place
                block = Block(batch["block"][i].as_py())
                if batch["asks"][i].as_py():
                    held.append(Nearest(block, k, metric))
                    continue
                for x in held:
                    x.meet(block, bool(same), fence is not None)
        yield rows(held)

    def rows(held: list[Nearest]) -> pa.RecordBatch:
        found = [(x.q.ids[x.row], x.id, x.score if metric == "cosine" else -x.score) for x in held]
        ids, others, scores = (np.concatenate([np.zeros(0, kind), *(f[j] for f in found)]) for j, kind in enumerate((np.int64, np.int64, float)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(scores)], names=["query_id", "id", "score"])

    lots = max(1, math.ceil(queries.count() / (QUERIES * HELD)))
    block = F.struct("n", *FIELDS.split()).alias("block")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = left.select(numbers(parts).alias("part"), F.pmod(F.xxhash64("ids", "times"), F.lit(lots)).cast("int").alias("lot"), F.lit(True).alias("asks"), block)
    given = right.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), numbers(lots).alias("lot"), F.lit(False).alias("asks"), block)
    both = asking.unionByName(given).repartition(parts * lots, "part", "lot").sortWithinPartitions("part", "lot", F.desc("asks"))
    best = both.mapInArrow(run, "query_id long, id long, score double")
    order = F.col("score").desc() if metric == "cosine" else F.col("score")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)
