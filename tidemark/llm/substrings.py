"""Exact removal of repeated word windows with a log-structured index of window fingerprints.

Documents are taken in batches: ranges of doc_ids with about as many rows, and less text than ``BATCH_CHARS`` at the
table's mean length, however ids are spread. A batch's distinct window hashes, in order,
are an immutable run, cut into ranges (buckets) of the hash. A bucket merges the runs of all batches in
their order, so for each run it knows which of its hashes an earlier batch has, and answers with one bit
for each hash. Each batch then marks its windows: those whose answer is set, and those that a document
with a smaller id in the batch has too. ``compact`` merges old runs into one, so that a later batch is
merged with few runs.

A hash stands once in a run however often its window occurs, so a passage that fills a third of a corpus
adds one entry for each batch. Runs are delta-coded, about six bytes a window. A hash of 64 bits decides
where runs are merged, and 16 bits of a second, independent hash verify each match.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, gram_hashes, mix, word_hashes, word_lists

#: Rows in a batch at most, characters in a batch, and window hashes in a bucket.
BATCH, BATCH_CHARS, BUCKET = 1024, 4 << 20, 1 << 21
#: Batches from which rows without a doc_id are dealt; they are neither duplicates nor sources.
SPARE = 64
#: Batch number of compacted runs.
HISTORY = -(1 << 62)

RUNS = "bucket int, batch long, n int, hashes binary, checks binary"
ANSWERS = "batch long, bucket int, bits binary"


def extent(docs: DataFrame) -> tuple[int, int]:
    """Rows and characters of a table."""
    found = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    return found[0], found[1] or 0


def batched(docs: DataFrame, batch: int = BATCH, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, the number of the batch of about ``batch`` rows, and a struct of the columns to carry along.

    Batches are in the order of their ids, and rows of one doc_id are in one batch.
    """
    doc = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry")] if carry else []
    rows = bucketed(docs.select(doc.alias("doc_id"), text.alias("text"), *rest), batch, split_ids=False)
    spare = -1 - (1 << 60) - F.pmod(F.xxhash64("text"), F.lit(SPARE))
    return rows.withColumn("batch", F.when(F.col("doc_id").isNull(), spare).otherwise(F.col("bucket"))).drop("bucket")


def batch_rows(rows: int, chars: int, batch: int = BATCH) -> int:
    """Rows of a batch, by the mean length of texts."""
    return max(1, min(batch, BATCH_CHARS * rows // max(1, chars)))


def bucket_bits(chars: int, per_bucket: int = BUCKET) -> int:
    """Power of two of the number of buckets, from the amount of text."""
    return max(0, int(chars / 6 / per_bucket).bit_length())


def encode_run(hashes: np.ndarray, floor: int) -> bytes:
    """Ascending hashes as byte planes of their differences; the first byte is the number of planes."""
    gaps = np.diff(hashes, prepend=np.uint64(floor)).astype("<u8")
    planes = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    return bytes([planes]) + gaps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def decode_run(blob: bytes, n: int, floor: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, : blob[0]] = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], n).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(floor)


def bucket_floors(bits: int) -> np.ndarray:
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)


def run_rows(batch: int, hashes: np.ndarray, checks: np.ndarray, bits: int) -> pa.Table:
    """A batch's run by bucket."""
    floors = bucket_floors(bits)
    cuts = np.append(np.searchsorted(hashes, floors), len(hashes))
    used = np.flatnonzero(np.diff(cuts))
    parts = [(int(b), int(cuts[b]), int(cuts[b + 1])) for b in used]
    columns = [[b for b, _, _ in parts], [batch] * len(parts), [q - p for _, p, q in parts], [encode_run(hashes[p:q], int(floors[b])) for b, p, q in parts], [checks[p:q].tobytes() for _, p, q in parts]]
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "batch", "n", "hashes", "checks"])


def merged(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a bucket, older batches first: batches, their sizes, hashes, checks, and the merge order (stable by hash and check)."""
    table = table.sort_by("batch")
    floor = int(bucket_floors(bits)[table["bucket"][0].as_py()])
    sizes = table["n"].to_numpy()
    hashes = np.concatenate([decode_run(h, int(n), floor) for h, n in zip(table["hashes"].to_pylist(), sizes, strict=True)])
    checks = np.concatenate([np.frombuffer(x, "<u2") for x in table["checks"].to_pylist()])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if (same & (checks[order][1:] != checks[order][:-1])).any():  # different windows with one hash
        order = np.lexsort((checks, hashes))
    return table["batch"].to_numpy(), sizes, hashes, checks, order


def answer(bits: int, elsewhere: bool) -> Callable[[pa.Table], pa.Table]:
    """For each run of a bucket, the bits of its hashes that an older run (elsewhere: any other run) has."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        batches, sizes, hashes, checks, order = merged(table, bits)
        same = (hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] == checks[order][:-1])  # found, and verified
        found = np.zeros(len(hashes), bool)
        found[order[1:]] = same
        if elsewhere:
            found[order[:-1]] |= same
        out = [(int(b), bucket, np.packbits(x).tobytes()) for b, x in zip(batches, np.split(found, np.cumsum(sizes)[:-1]), strict=True) if x.any()]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["batch", "bucket", "bits"])

    return run


def compact(runs: DataFrame, bits: int) -> DataFrame:
    """One run for each bucket, older than any batch, that holds the hashes of all ``runs`` (two equal hashes with different checks stay two)."""

    def run(table: pa.Table) -> pa.Table:
        _, _, hashes, checks, order = merged(table, bits)
        hashes, checks = hashes[order], checks[order]
        first = np.append(True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1]))
        kept, bucket = hashes[first], table["bucket"][0].as_py()
        floor = int(bucket_floors(bits)[bucket])
        return pa.table([pa.array([bucket], pa.int32()), pa.array([HISTORY], pa.int64()), pa.array([len(kept)], pa.int32()), pa.array([encode_run(kept, floor)], pa.binary()), pa.array([checks[first].tobytes()], pa.binary())], names=["bucket", "batch", "n", "hashes", "checks"])

    return runs.groupBy("bucket").applyInArrow(run, RUNS)


class Windows:
    """The windows of one batch, its documents in the order of their ids."""

    def __init__(self, table: pa.Table, length: int):
        self.table = table.sort_by("doc_id").combine_chunks()
        self.first, self.words = word_lists(self.table["text"])
        n = np.diff(self.first)
        self.docs = np.repeat(np.arange(len(n)), n)
        self.hashed = word_hashes(self.words)
        self.ids = pc.fill_null(self.table["doc_id"], -1).to_numpy()
        self.known = pc.is_valid(self.table["doc_id"]).to_numpy()
        self.at = self.starts(length)

    def starts(self, length: int) -> np.ndarray:
        """Where windows of that many words start, in documents that have an id."""
        inside = self.docs[: len(self.docs) - length + 1] == self.docs[length - 1 :] if len(self.docs) >= length else np.zeros(0, bool)
        return np.flatnonzero(inside & self.known[self.docs[: len(inside)]])

    def hashes(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and check of the windows that start at ``at``."""
        return gram_hashes(self.hashed, length)[at], gram_hashes(mix(self.hashed ^ np.uint64(0xA5A5A5A5A5A5A5A5)), length)[at].astype("<u2")

    def distinct(self, hashes: np.ndarray, checks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending distinct hashes, their checks, the number of each window's hash, and for each window whether a document with a smaller id has it."""
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ids = self.ids[self.docs[at]]
        return values, checks[first], inverse, (ids > ids[first][inverse]) & (checks == checks[first][inverse])


def bits_of(answers: pa.Table, values: np.ndarray, bits: int) -> np.ndarray:
    """The answers to a run, for each of its hashes."""
    cuts = np.append(np.searchsorted(values, bucket_floors(bits)), len(values))
    out = np.zeros(len(values), bool)
    for bucket, blob in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        a, b = int(cuts[bucket]), int(cuts[bucket + 1])
        out[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
    return out


def covered(windows: Windows, at: np.ndarray, length: int) -> np.ndarray:
    """Words that a window starting at one of ``at`` covers."""
    edges = np.zeros(len(windows.docs) + 1, np.int32)
    edges[at] += 1
    np.subtract.at(edges, at + length, 1)
    return np.cumsum(edges[:-1]) > 0


def kept_texts(windows: Windows, gone: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    first = np.concatenate([[0], np.cumsum(~gone)])[windows.first]
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), windows.words.filter(pa.array(~gone)))
    return pc.binary_join(lists, " ")


def runs_of(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    """The run of every batch."""

    def run(table: pa.Table) -> pa.Table:
        windows = Windows(table, length)
        hashes, checks = windows.hashes(length, windows.at)
        values, first = np.unique(hashes, return_index=True)
        return run_rows(table["batch"][0].as_py(), values, checks[first], bits)

    return blocks.groupBy("batch").applyInArrow(run, RUNS)


def remove_repeats(docs: DataFrame, length: int = 13, batch: int = BATCH, history: DataFrame | None = None, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of each row of ``docs``.

    A word goes if a window of ``length`` words that covers it also starts in a document with a smaller doc_id, or
    in ``history``, the runs of earlier calls (``runs_of`` and ``compact`` with the same ``length`` and ``bits``).
    Windows are judged on the input. Null and empty texts have no words. Rows with one doc_id don't count against
    each other; rows without a doc_id stay whole and count against none. A text is whole in its batch however long
    it is. Only doc_id and text are read, so other columns don't matter. An empty table gives no rows.
    """
    rows, chars = extent(docs)
    bits = bucket_bits(chars) if bits is None else bits
    blocks = batched(docs, batch_rows(rows, chars, batch))
    runs = runs_of(blocks, length, bits)
    runs = runs if history is None else runs.unionByName(history)
    answers = runs.groupBy("bucket").applyInArrow(answer(bits, elsewhere=False), ANSWERS)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _results(None, None)
        windows = Windows(table, length)
        hashes, checks = windows.hashes(length, windows.at)
        values, _, inverse, seen = windows.distinct(hashes, checks, windows.at)
        seen |= bits_of(answers, values, bits)[inverse]
        return _results(windows, covered(windows, windows.at[seen], length))

    return blocks.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def _results(windows: Windows | None, gone: np.ndarray | None) -> pa.Table:
    names, types = ["doc_id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    if windows is None:
        return pa.table([pa.array([], t) for t in types], names=names)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[windows.first])
    return pa.table([windows.table["doc_id"], pa.array(np.diff(windows.first), pa.int64()), pa.array(removed, pa.int64()), kept_texts(windows, gone)], names=names)
