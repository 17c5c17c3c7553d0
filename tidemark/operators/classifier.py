"""The text-score classifier: dataset, training, scoring and evaluation over vectors; and hooks for user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, logistic
from ..sources.written import written


def dataset(features: DataFrame, labels: DataFrame, keys: tuple[str, ...], vector: str = "h_text") -> DataFrame:
    """Features with labels by their keys: x and y (1 where the label is 1), rows without a label left out.

    The dimension is checked in the same job: a row whose size differs from the table's smallest is an error.
    """
    joined = features.join(labels.where("label is not null"), list(keys))
    size = features.agg(F.min(F.size(vector)).alias("_dim"))
    checked = F.when(F.size(vector) == F.col("_dim"), F.col(vector)).otherwise(F.raise_error(F.lit("vectors differ in dimension")))
    return joined.join(F.broadcast(size)).select(*keys, checked.alias("x"), F.when(F.col("label") == 1, 1).otherwise(0).alias("y"))  # one row is broadcast


def start_weights(dim: int, seed: int = 42) -> list[float]:
    """Where descent starts: normal draws with deviation 0.01."""
    return np.random.default_rng(seed).normal(0.0, 0.01, dim).tolist()


def descend(data: DataFrame, w: list[float], bias: float = 0.0, rate: float = 0.1, epochs: int = 200) -> tuple[list[float], float]:
    """Weights and bias of the logistic loss after so many steps of full-batch gradient descent, all rows in each.

    data: x and y (0 or 1). Rows are packed into matrices once and kept; an epoch is one job, in which every task adds up
    its rows' gradients and the d + 1 sums are combined before they are sent. The driver has the weights alone. A row
    with a null or of another dimension than ``w`` is an error, as is an empty table; repeated rows count each.
    """
    dim = len(w)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch["x"].flatten().to_numpy(zero_copy_only=False)
            if batch["x"].null_count or (pc.list_value_length(batch["x"]).to_numpy() != dim).any() or np.isnan(flat).any() or not np.isin(batch["y"].to_numpy(zero_copy_only=False), (0.0, 1.0)).all():
                raise ValueError(f"every row needs {dim} numbers and a label 0 or 1")
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([batch["y"].to_numpy().tobytes()], pa.binary())], names=["x", "y"])

    rows = data.select(F.transform("x", lambda v: v.cast("double")).alias("x"), F.col("y").cast("double").alias("y"))
    blocks = written(rows.mapInArrow(pack, "x binary, y binary")).persist()

    def gradient(w: np.ndarray, bias: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dim + 2)
            for batch in batches:
                for a, b in zip(batch["x"], batch["y"], strict=True):
                    x, y = np.frombuffer(a.as_buffer()).reshape(-1, dim), np.frombuffer(b.as_buffer())
                    error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -50, 50))) - y
                    total += np.concatenate([x.T @ error, [error.sum(), len(y)]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

        return run

    now, sums = np.array(w, float), [F.sum(F.col("g")[i]) for i in range(dim + 2)]
    for _ in range(epochs):
        *slope, lean, n = blocks.mapInArrow(gradient(now, bias), "g array<double>").agg(*sums).first()
        if not n:
            raise ValueError("no rows to learn from")
        now, bias = now - rate * np.array(slope) / n, bias - rate * lean / n
    blocks.unpersist()
    return now.tolist(), float(bias)


def train(data: DataFrame, iterations: int = 100) -> LogisticRegressionModel:
    """The same loss brought to its minimum by the library's own method, in fewer passes than ``descend``."""
    rows = data.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"), F.col("y").cast("double").alias("label"))
    return LogisticRegression(maxIter=iterations, regParam=0.0, elasticNetParam=0.0, tol=1e-6).fit(rows)


def weights(model: LogisticRegressionModel) -> tuple[list[float], float]:
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score(x: Column, w: list[float], bias: float) -> Column:
    """Probability of label 1: the logistic function of weights times x plus bias."""
    return logistic(dot(x, F.array(*map(F.lit, w))) + bias)


def evaluate(scored: DataFrame, vector: str = "x") -> DataFrame:
    """accuracy, positive_rate, n and dim of rows with y and predicted."""
    right = F.avg(F.when(F.col("y") == F.col("predicted"), 1.0).otherwise(0.0))
    return scored.agg(right.alias("accuracy"), F.avg(F.col("predicted").cast("double")).alias("positive_rate"), F.count("*").alias("n"), F.max(F.size(vector)).alias("dim"))


def predictions(model: LogisticRegressionModel, data: DataFrame) -> DataFrame:
    """Scores of the library's model, for comparison with ``score``."""
    rows = data.withColumn("features", array_to_vector(F.transform("x", lambda v: v.cast("double"))))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def with_function(df: DataFrame, column: str, out: str, kind: str, function: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Adds ``out`` = function(column), a user's callable over Arrow batches (embeddings, summaries)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: function(batch[column])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` {kind}")
