"""Correlations by blocks against numpy."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import graph


@pytest.mark.parametrize("size", [256, 3, 1])
def test_correlations_of_blocks(spark, monkeypatch, size):
    """Missing days, symbols without returns, constants, infinities, nulls; blocks of many sizes."""
    monkeypatch.setattr(graph, "SYMBOLS", size)
    rng = random.Random(1)
    rets = {(f"s{k}", d): rng.choice([None, float("nan"), math.inf] + [rng.gauss(0, 1)] * 8) for k in range(7) for d in range(20) if rng.random() < 0.7}
    rets |= {("flat", d): 0.5 for d in range(20)} | {("none", 0): None, ("single", 3): 0.1}
    df = spark.createDataFrame([(s, f"2026-01-{d + 1:02}", r) for (s, d), r in rets.items()], "symbol string, date string, ret double").repartition(3)
    edges = graph.correlation_edges(df, 0.2, 0.125)
    assert "NestedLoop" not in edges._jdf.queryExecution().toString() and "Cartesian" not in edges._jdf.queryExecution().toString()
    found = {(r.target, r.source): r.weight for r in edges.collect()}
    names = sorted({s for s, _ in rets})
    assert len(found) == len(names) ** 2
    for a in names:
        for b in names:
            both = [(rets[a, d], rets[b, d]) for d in range(20) if all(rets.get((s, d)) is not None and math.isfinite(rets[s, d]) for s in (a, b))]
            x, y = np.array(both).T if both else (np.zeros(0), np.zeros(0))
            want = 0.125 if len(both) < 2 or x.std() < 1e-12 or y.std() < 1e-12 else float(np.corrcoef(x, y)[0, 1])
            want = 1.0 if a == b else want if want == 0.125 or abs(want) >= 0.2 else 0.0
            assert found[a, b] == pytest.approx(want, abs=1e-9), (a, b)


def test_no_symbols(spark):
    assert graph.correlation_edges(spark.createDataFrame([], "symbol string, date date, ret double")).count() == 0
