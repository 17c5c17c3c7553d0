"""Hard negatives against a plain version, and the bounds against exact angles."""

import math
import random

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidemark.llm import hardneg, queries as llm

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, norm int, a int"


def brute(rows, positives=5, negatives=3, every=50):
    fine = []
    for doc, vector, label in rows:
        if doc is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            fine.append((doc, (label + 1) % 10 if doc % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for i, (anchor, own, a) in enumerate(fine):
        if anchor % every:
            continue
        score = [sum(x * y for x, y in zip(a, v)) for _, _, v in fine]
        order = sorted((j for j in range(len(fine)) if j != i), key=lambda j: (-score[j], fine[j][0]))
        for p in [j for j in order if fine[j][1] == own][:positives]:
            found = [j for j in order if fine[j][1] != own and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:negatives]
            out += [(anchor, fine[p][0], rank, fine[j][0], score[p], score[j]) for rank, j in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    whole = lambda v: v and [x if x is None else float(x) for x in v]
    return spark.createDataFrame([(doc, whole(v), label, "u", 1, 2) for doc, v, label in rows], SCHEMA)


def run(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hardneg.hard_negatives(df, label, **options).collect()))


def test_edges(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0.1, 0.3) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for k in range(160)]
    rows += [(200, None, 1), (201, [0.5, None], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] + [0.0] * 5, 1), (204, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    rows += [(250, [], 0), (206, [0.0] * 6, 0), (300, [0.4, 0.4], 1), (207, [0.3] * 9, 0), (208, [-5e4, 3e5, 1.5, 0, 0, 0], 2), (350, [2e5, 2e5, 0, 0, 0, 0], 2), (209, [1e5, 1e5, 1, 1, 1, 1], 0)]
    rows += [(210 + k, [0.25] * 6, k % 3) for k in range(12)]  # ties
    rows += [(400, [0.25] * 6, 1), rows[50], rows[3]]  # repeated rows: each its own
    df = table(spark, rows).repartition(3)
    assert run(df) == brute(rows)
    assert run(df, positives=2, negatives=1) == brute(rows, 2, 1)
    assert run(df.where("vec_id < 0")) == [] and run(df.where("vec_id % 50 <> 0")) == [] and run(df.where("label = 0 and vec_id % 7 <> 0")) == []


def test_small_blocks_are_the_same(spark, monkeypatch):
    """Many blocks, most of them out of every window."""
    monkeypatch.setattr(hardneg, "ROWS", 8)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(k, (centres[k % 5] + rng.normal(scale=0.15, size=8)).tolist(), int(k % 5 if k % 3 else (k + 1) % 5)) for k in range(400)]
    df = table(spark, rows).repartition(4)
    assert run(df) == brute(rows)


def test_scores_beyond_a_long_are_an_error(spark):
    df = table(spark, [(k, [3e18, 1.0], 0) for k in (50, 51)])
    with pytest.raises(Exception, match="OverflowError"):
        run(df)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for spread in (0.02, 0.5, 3.0):
        base = rng.normal(size=(2, 12))
        make = lambda n, at: np.floor(256 * (base[at] + rng.normal(scale=spread, size=(n, 12))))
        a, r, refs = make(20, 0), make(30, 1), rng.normal(size=(6, 12))
        refs /= np.linalg.norm(refs, axis=1)[:, None]

        class Made(hardneg.Block):
            def __init__(self, v):
                self.ids, self.norms = np.arange(len(v)), np.sqrt((v * v).sum(1))
                self.angles = hardneg.angles(v, self.norms, refs)
                self.low, self.high, self.bounded = self.angles.min(0), self.angles.max(0), True
                self.most, self.least = self.norms.max(), self.norms.min()

        x, y = Made(a), Made(r)
        exact = a @ r.T
        low, high = hardneg.row_bounds(x, np.arange(20), y)
        assert (low <= exact).all() and (exact <= high).all()
        low, high = hardneg.block_bounds(x, y)
        assert (low[:, None] <= exact).all() and (exact <= high[:, None]).all()


def test_larger_table(spark, duck):
    sql = llm.HARD_NEGATIVES.replace("FROM embeddings", "FROM '/root/testdata/sf0.1/embeddings.parquet'")
    assert_same(llm.op12_hardneg(spark, "/root/testdata/sf0.1"), duck, sql)


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    """A copy of all anchors for each part is more than their file tells, so no side of a join is broadcast."""
    monkeypatch.setattr(hardneg, "ROWS", 8)
    rng = np.random.default_rng(6)
    df = table(spark, [(k, rng.normal(0, 1, 4).round(2).tolist(), int(rng.integers(3))) for k in range(200)])
    plan = hardneg.hard_negatives(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
