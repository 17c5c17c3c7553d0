"""Removal of long passages that repeat across documents, with sparse suffix arrays.

Of all suffixes of a batch of documents, only those are retained that start at a minimiser: the k-word gram with
the smallest hash of some window of ``length`` words. Equal windows have equal minimisers, so each repeated
passage of that length has a retained suffix at the same place in each copy. Retained suffixes are sorted by the
fingerprint of their first k words and merged across batches, and neighbours are compared: a suffix whose start
no other document has is done with. Around the others (a few hundredths of the positions in unrelated texts),
matches are extended to the left and right: each window of ``length`` words about the suffix is fingerprinted,
sorted and compared, and the union of the windows that a smaller doc_id has too is the passage to remove.

A plain sort of suffix texts would gather all copies of a common passage, each with another continuation, in one
task. Here each batch sends a fingerprint once, however many of its documents have the passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix
from .substrings import ANSWERS, BATCH, RUNS, Windows, answer, batch_rows, batched, bits_of, bucket_bits, covered, extent, kept_texts, run_rows

#: Words of a passage, and of the gram that a retained suffix starts with.
LENGTH, GRAM = 50, 16


class Suffixes(Windows):
    """The retained suffixes of one batch, and the windows of each."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        super().__init__(table, length)
        self.length = length
        grams, reach = gram_hashes(self.hashed, gram), length - gram + 1
        span = 1
        while span * 2 <= reach:  # smallest of the next ``span`` grams
            grams = np.minimum(grams[: max(0, len(grams) - span)], grams[span:])
            span *= 2
        self.starts_with = mix(np.minimum(grams[self.at], grams[self.at + reach - span])) if len(self.at) else np.zeros(0, np.uint64)  # smallest hashes, spread over all buckets again
        order = np.argsort(self.starts_with, kind="stable")
        ranked = self.starts_with[order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(ranked)) - 1 if len(heads) else heads
        docs = self.docs[self.at][order]
        self.values = ranked[heads]
        self.number = np.empty(len(ranked), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.local = docs[heads] != docs[tails]  # documents are in the order of their positions

    def run(self, batch: int, bits: int) -> pa.Table:
        return run_rows(batch, self.values, (self.values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2"), bits)

    def extended(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows about the suffixes that ``shared`` marks, with their hashes and checks."""
        at = self.at[shared[self.number]]
        return at, *self.hashes(self.length, at)


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word, word after the last) and text of each row; the columns of ``carry`` come in a struct of that name.

    A word goes if a passage of at least ``length`` words that covers it also stands in a document with a smaller
    doc_id. ``text`` is the text itself where nothing goes, else the kept words joined by one space. Null and empty
    texts have no words. Rows with one doc_id don't count against each other; rows without a doc_id stay whole and
    count against none. A text is whole in its batch however long it is. An empty table gives no rows.
    """
    rows, chars = extent(docs)
    bits = bucket_bits(chars)
    blocks = batched(docs, batch_rows(rows, chars, batch), carry)
    passages = blocks.select("doc_id", "text", "batch")

    def retained(table: pa.Table) -> pa.Table:
        return Suffixes(table, length, gram).run(table["batch"][0].as_py(), bits)

    def extensions(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return run_rows(0, np.zeros(0, np.uint64), np.zeros(0, "<u2"), bits)
        suffixes = Suffixes(table, length, gram)
        _, hashes, checks = suffixes.extended(bits_of(answers, suffixes.values, bits))
        values, first = np.unique(hashes, return_index=True)
        return run_rows(table["batch"][0].as_py(), values, checks[first], bits)

    neighbours = passages.groupBy("batch").applyInArrow(retained, RUNS).groupBy("bucket").applyInArrow(answer(bits, elsewhere=True), ANSWERS)
    runs = passages.groupBy("batch").cogroup(neighbours.groupBy("batch")).applyInArrow(extensions, RUNS)
    repeats = runs.groupBy("bucket").applyInArrow(answer(bits, elsewhere=False), ANSWERS)
    answers = neighbours.withColumn("extended", F.lit(False)).unionByName(repeats.withColumn("extended", F.lit(True)))
    carried = bool(carry)
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,stop:long>>, text string" + (f", carry {blocks.schema['carry'].dataType.simpleString()}" if carried else "")
    names = ["doc_id", "n_words", "n_removed", "spans", "text"] + ["carry"] * carried
    types = [pa.int64(), pa.int64(), pa.int64(), spans_type := pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])), pa.string()]

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table([pa.array([], t) for t in types] + ([table["carry"]] if carried else []), names=names)
        suffixes = Suffixes(table, length, gram)
        told = answers["extended"]
        elsewhere = bits_of(answers.filter(pc.invert(told)), suffixes.values, bits)
        sent = np.unique(suffixes.extended(elsewhere)[1])
        older = sent[bits_of(answers.filter(told), sent, bits)]
        at, hashes, checks = suffixes.extended(elsewhere | suffixes.local)
        _, _, _, seen = suffixes.distinct(hashes, checks, at)
        seen |= np.isin(hashes, older)
        gone = covered(suffixes, at[seen], length)
        first = suffixes.first
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        spans = []
        for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), removed.tolist(), strict=True):
            inner = gone[a:b] if n else ()
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], inner, [0]]).astype(np.int8))).tolist() if n else []
            spans.append([{"first": x, "stop": y} for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
        text = pc.if_else(pa.array(removed > 0), kept_texts(suffixes, gone), suffixes.table["text"])
        columns = [suffixes.table["doc_id"], pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_type), text]
        return pa.table(columns + ([suffixes.table["carry"]] if carried else []), names=names)

    return blocks.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema)
