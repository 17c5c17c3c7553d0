"""From raw documents to packed training sequences.

STAGES run in order; each takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of documents (the last: the packed pieces). ``run`` writes each stage's result as Parquet in the shared folder
and reads it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, quality, suffixes
from tidemark.llm.common import documents, ensure_checkpoint_dir

#: No SQL: a trained classifier and a tokenizer decide. tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels next to the documents.

    Null and empty texts are scored as empty ones; a very long text is scored whole. Each row is judged by its text
    alone, so repeated rows and ids don't matter, and columns are only carried. Without enough labels nothing goes.
    An empty table gives no rows.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, carry=docs.columns)
    return scored.where(F.col("score") >= quality.THRESHOLD).select("carry.*")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Rows are judged each by its own text, also where they share a doc_id; rows that share a doc_id and a text are one
    document and stay or go together. Texts without words (null, empty, blank) and rows without a doc_id stay. Very long
    texts are compared whole; an empty table gives no rows; all columns are kept as they are.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")


def passage_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller doc_id has; those left without a word go.

    Documents that had no word (null, empty, blank) stay, as do those without a doc_id. Rows that share a doc_id don't
    count against each other. n_chars follows a text that was cut; other columns are only carried. An empty table gives
    no rows.
    """
    found = suffixes.remove_passages(docs, carry=[c for c in docs.columns if c != "text"])
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    rows = left.select("carry.*", "text", "n_removed")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per reading of a document by the mix, in the order of training.

    Documents without words (null, empty, blank) have nothing to read, so they give no row; a null source is a source.
    Repeated rows are documents of their own, read one after the other. A document at its source's end is cut.
    An empty table gives no rows.
    """
    ensure_checkpoint_dir(spark)
    return mixing.schedule(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 ids; see ``packing.pack`` for nulls, long texts, repeats and empty tables."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicate_filter),
    ("suffix_array_dedup", passage_filter),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
