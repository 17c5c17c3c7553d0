"""Nearest vectors when the queries are more than one lot, which each task holds by itself."""

import random

from pyspark.sql import functions as F

from tidemark.operators import neighbours


def test_lots_of_queries(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = df.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    tell = lambda: sorted(map(tuple, neighbours.nearest(queries, df, 4, "l2").collect()))
    whole = tell()
    monkeypatch.setattr(neighbours, "QUERIES", 8)
    monkeypatch.setattr(neighbours, "VECTORS", 16)
    monkeypatch.setattr(neighbours, "HELD", 3)
    assert tell() == whole and len(whole) == 400
    # rows that reach a task have one block each, of queries or of vectors, never a pair of blocks
    plan = neighbours.nearest(queries, df, 4, "l2")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
