"""The text-score classifier over embeddings, label 1 against the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier
from .registry import query
from .views import table, view

WEIGHTS = [((k * 7) % 13 - 6) / 4 for k in range(64)]
BIAS = 0.1
LABELS = "labels_at AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 3 AS INTEGER) - 1 END AS label FROM events)"


def dataset_of(spark, sf_dir):
    labels = table(spark, sf_dir, "events").selectExpr("event_id as id", "case when event_id % 9 = 0 then null else cast(event_id % 3 as int) - 1 end as label")
    return classifier.dataset(view(spark, sf_dir, "memories").select("id", "embedding"), labels, ("id",), "embedding")


def vectors_of(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.when(F.col("label") == 1, 1).otherwise(0).alias("y"))


@query(f"WITH {LABELS} SELECT id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y, CAST(len(embedding) AS INTEGER) AS dim FROM memories JOIN labels_at USING (id) WHERE label IS NOT NULL", "memories")
def text_score_dataset(spark, sf_dir):
    return dataset_of(spark, sf_dir).select("id", "y", F.size("x").alias("dim"))


_W = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
SCORED = f"""z AS (SELECT vec_id AS id, label, list_sum(list_transform(list_zip(embedding, {_W}), lambda p: p[1]::DOUBLE * p[2])) + {BIAS}::DOUBLE AS z FROM embeddings),
scored AS (SELECT id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y, round(1 / (1 + exp(-least(greatest(z, -50), 50))), 6) AS score FROM z)"""


@query(f"WITH {SCORED} SELECT id, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored")
def text_score_predict(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).select("id", F.round(classifier.score(F.col("x"), WEIGHTS, BIAS), 6).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query(f"WITH {SCORED} SELECT round(avg(CASE WHEN y = CASE WHEN score >= 0.5 THEN 1 ELSE 0 END THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN score >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS positive_rate, count(*) AS n, 64 AS dim FROM scored")
def text_score_eval(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).withColumn("score", F.round(classifier.score(F.col("x"), WEIGHTS, BIAS), 6)).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return classifier.evaluate(rows).select(F.round("accuracy", 6).alias("accuracy"), F.round("positive_rate", 6).alias("positive_rate"), "n", "dim")


def scored_by(data, w, bias):
    return data.select("id", "y", F.round(classifier.score(F.col("x"), w, bias), 6).alias("score"))


@query()
def text_score_train(spark, sf_dir):
    """Scores after descent over all 64 components (no SQL: compared with numpy)."""
    data = vectors_of(spark, sf_dir)
    return scored_by(data, *classifier.descend(data, classifier.start_weights(64)))


_START = classifier.start_weights(3)


@query(
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END AS y FROM embeddings),
w AS (SELECT 0 AS epoch, {_START[0]!r}::DOUBLE AS w0, {_START[1]!r}::DOUBLE AS w1, {_START[2]!r}::DOUBLE AS w2, 0e0 AS b
      UNION ALL SELECT epoch + 1, w0 - 0.1e0 * avg(e * x0), w1 - 0.1e0 * avg(e * x1), w2 - 0.1e0 * avg(e * x2), b - 0.1e0 * avg(e)
      FROM (SELECT w.*, d.*, 1 / (1 + exp(-least(greatest(w0 * x0 + w1 * x1 + w2 * x2 + b, -50), 50))) - y AS e FROM w, d WHERE epoch < 200) GROUP BY epoch, w0, w1, w2, b)
SELECT id, CAST(y AS INTEGER) AS y, round(1 / (1 + exp(-least(greatest(w0 * x0 + w1 * x1 + w2 * x2 + b, -50), 50))), 6) AS score FROM d, w WHERE epoch = 200"""
)
def text_score_train3(spark, sf_dir):
    """The same over the first three components, which SQL can follow step by step."""
    data = vectors_of(spark, sf_dir).withColumn("x", F.slice("x", 1, 3))
    return scored_by(data, *classifier.descend(data, _START))
