"""Full-batch descent against numpy."""

import numpy as np
import pytest
from compare import DATA

from tidemark import plans
from tidemark.operators import classifier


def plain(x, y, w, rate=0.1, epochs=200):
    w, b = np.array(w, float), 0.0
    for _ in range(epochs):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y
        w, b = w - rate * x.T @ e / len(y), b - rate * e.mean()
    return w, b


def test_weights_are_numpys(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [1, 10, 100, 1, 1]  # logits beyond 50 too
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)
    w, b = classifier.descend(df, classifier.start_weights(5), epochs=25)
    want, bias = plain(x, y, classifier.start_weights(5), epochs=25)
    assert w == pytest.approx(want, abs=1e-9) and b == pytest.approx(bias, abs=1e-9)
    assert classifier.descend(df, [0.5] * 5, 0.25, epochs=0) == ([0.5] * 5, 0.25)
    for bad in (df.limit(0), df.selectExpr("slice(x, 1, 4) as x", "y"), df.selectExpr("x", "2 as y"), df.selectExpr("cast(null as array<double>) as x", "y")):
        with pytest.raises(Exception, match="every row needs|no rows"):
            classifier.descend(bad, [0.0] * 5, epochs=2)


def test_the_registered_scores(spark):
    found = {r["id"]: (r.y, r.score) for r in plans.queries()["text_score_train"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label == 1 for r in rows], int)
    w, b = plain(x, y, classifier.start_weights(64))
    score = 1 / (1 + np.exp(-(x @ w + b)))
    assert {k: v[0] for k, v in found.items()} == {r.vec_id: int(t) for r, t in zip(rows, y, strict=True)}
    assert [found[r.vec_id][1] for r in rows] == pytest.approx(score.tolist(), abs=1e-6)
