"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled texts, one from each class. A text's pieces (sentences and lines, the
longer ones every ``PIECE`` bytes) are compressed one by one with both; a text like the good ones gets smaller with the
good dictionary. Pieces are short, so that what a text repeats within itself doesn't hide what it shares with a class.
The difference of the two sizes, normalised by their sum, is the score: it is calibrated to a probability by a logistic
curve, at equal odds of the two labels. For that, each half of the sample is scored with dictionaries of the other half.

The classifier is fitted on a bounded sample: ``PER_CLASS`` ids of each class, the first in the order of a hash of
the ids, among labelled texts of at most ``LONGEST`` characters. Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PER_CLASS, LONGEST, DICTIONARY, PIECE, LEVEL = 1200, 30_000, 65_536, 256, 3
PIECES = re.compile(rb"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]{1,%d}" % (PIECE, PIECE))
THRESHOLD = 0.3

def fold(doc_id: Column) -> Column:
    """0 for held-out documents, from the id alone."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(compression_params=parameters)
            out.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        return out


def difference(texts: list[bytes], compressors: list) -> np.ndarray:
    """For each text, how much smaller the good dictionary makes it than the bad one, in hundredths of both sizes; 0 for an empty text."""
    good, bad = (c.compress for c in compressors)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        a = b = 0
        for piece in PIECES.finditer(text):
            a += len(good(piece[0]))
            b += len(bad(piece[0]))
        out[i] = 100 * (b - a) / max(1, a + b)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    """Fits on labelled documents whose fold isn't 0. With fewer than 20 usable texts of a class, every score is 0.5.

    Null and empty texts, longer ones and labels other than 0 and 1 don't count. An id with both labels counts as good,
    and of a repeated doc_id one text is taken (the first in code point order), so the sample is bounded in rows.
    """
    import zstandard

    turn = F.xxhash64("doc_id")
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = None
    for value in (0, 1):
        some = usable.where(F.col("quality") == value).orderBy(turn, "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, longest))
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most 2 * per_class
    rows = sorted((r["doc_id"], r["quality"], r["text"].encode()) for r in sample.collect())
    classes = [[t for _, q, t in rows if q == value] for value in (0, 1)]
    if min(map(len, classes)) < 20:
        return Model(b"", b"", [0.0, 0.0])

    def dictionary(texts: list[bytes]) -> bytes:
        pieces = [piece for t in texts for piece in PIECES.findall(t)]
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, pieces)) // 4), pieces, level=LEVEL).as_bytes()

    found, truth = [], []
    for k in (0, 1):  # each half is scored with dictionaries of the other one
        bad, good = ([t for i, t in enumerate(texts) if i % 2 == k] for texts in classes)
        other = [t for texts in classes for i, t in enumerate(texts) if i % 2 != k]
        found.append(difference(other, Model(dictionary(good), dictionary(bad), []).compressors()))
        truth.append(np.repeat([0.0, 1.0], [len(classes[0]) - len(bad), len(classes[1]) - len(good)]))
    x, y = np.concatenate(found), np.concatenate(truth)
    weights = logistic(np.stack([np.ones(len(x)), x], 1), y)
    weights[0] -= np.log(y.sum() / (len(y) - y.sum()))  # calibrated at equal odds of the two labels
    return Model(dictionary(classes[1]), dictionary(classes[0]), weights.tolist())


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1) of each row's whole text, and a struct ``carry`` of those columns, whatever their names.

    Null texts count as empty ones, which get the calibration's own odds. A very long text is scored whole. Order and
    repeated rows or ids don't matter: each row is judged by its text alone. An empty table gives no rows.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry")] if carry else []
    carried = bool(carry)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    schema = "doc_id long, score double" + "".join(f", carry {f.dataType.simpleString()}" for f in asked.schema.fields if f.name == "carry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.good else None
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = (x or b"" for x in part["text"].cast(pa.binary()).to_pylist())
                found = difference(list(texts), compressors) if compressors else np.zeros(len(part))
                found = 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * found, -30, 30)))
                columns = [part["doc_id"], pa.array(found, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns + ([part["carry"]] if carried else []), names=["doc_id", "score"] + ["carry"] * carried)

    return asked.mapInArrow(run, schema)
