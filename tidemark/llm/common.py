"""Arrow and numpy helpers that run inside tasks, and small Spark helpers shared by the operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word contracts, as a Java/RE2 character class body.
BLANKS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder the cluster names; only a local session without one (a test) gets a local folder."""
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", ""):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder; smaller than a checkpoint, and as safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(rows: DataFrame, bucket: int, quantiles: int = 1000, split_ids: bool = True) -> DataFrame:
    """Adds ``bucket``, which never falls as (doc_id, tie) rises and has about so many rows, however ids are spread or repeated.

    Ids go by at most ``quantiles`` quantiles, evenly between two of them, and rows of one id that fills several by tie,
    unless an id must stay whole (``split_ids``; then rows need no tie).
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = rows.count()
    groups = max(1, min(quantiles, math.ceil(n / bucket)))
    cuts = rows.agg(F.percentile_approx(key, [k / groups for k in range(groups + 1)], 10 * quantiles)).first()[0] if n else []
    if not cuts:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    inner = math.ceil(n / groups / bucket)
    steps = ", ".join(str(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1))
    known = rows.withColumn("cuts", F.array(*(F.lit(x).cast("long") for x in cuts))).withColumn("key", key)
    below = lambda sign: F.expr(f"aggregate(array({steps}), 0, (p, s) -> case when p + s <= {len(cuts)} and cuts[p + s - 1] {sign} key then p + s else p end)")
    known = known.withColumn("lower", below("<")).withColumn("upper", below("<="))
    spread = F.floor((F.col("tie") / float(1 << 64) + 0.5) * (F.col("upper") - F.col("lower")) * inner) if split_ids else F.lit(0)
    from_, to = (F.get("cuts", F.col("lower") + k).cast("double") for k in (-1, 0))
    between = F.coalesce(F.floor((F.col("key") - from_) / (to - from_) * inner), F.lit(0))
    wide = inner * (len(cuts) + 1) + 1
    equal = F.col("upper") > F.col("lower")
    place = F.when(equal, spread).otherwise(between).cast("long")
    return known.withColumn("bucket", (2 * F.col("lower") + equal.cast("int")) * F.lit(wide).cast("long") + place).drop("cuts", "key", "lower", "upper")


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Runs of characters other than ASCII white space: (first word of each text, and the end), all words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return before[bounds], flat.filter(pa.array(real))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, also across texts; the caller keeps those within one."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    factor = 1
    for j in range(n):
        out += words[j : j + m] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    return mix(out)


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = 16 << 20):
    """Consecutive parts of a batch with about ``most`` bytes of text each; a longer text is alone in its part."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    at = 0
    while at < len(size):
        floor = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, floor + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
