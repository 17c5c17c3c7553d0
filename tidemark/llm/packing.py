"""Packing documents into fixed-length token sequences by minimum bin slack.

Every task packs the documents it reads, so packing shuffles nothing. A document's ids are cut into
whole windows, which are sequences of their own, and a remainder. The remainders of a task wait in a
pool. For each window, the longest remainder is placed, and a subset-sum dynamic programme over the
pool's remaining lengths (one bit for each reachable fill, each length at most as often as the pool
has it) finds the multiset that comes closest to the capacity; the counts are found by walking the
bitsets back. Slack that is left is filled by cutting one more remainder. The last window of a task
is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, word_lists

WINDOW = 2048
#: Ids that may wait in a task's pool, ids that stay in it for a later choice, and ids in a batch of results.
POOL_HIGH, POOL_LOW, OUTPUT = 4_000_000, 1_000_000, 500_000

#: Words that the tokenizer takes as one run (of letters), and as two (letters, then punctuation but the apostrophe).
LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
RUNS_OF = (f"^[{LETTERS}]+$", rf"^[{LETTERS}]+[!-&(-/:-@\[-`{{-~]+$")

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of white-space-separated words. A word is given to the tokenizer once and then looked up.

    The tokenizer lower-cases, and splits at white space and between a letter or digit and punctuation,
    so a word's ids don't depend on its neighbours, and one final full stop or comma has ids of its own.
    A word with ``<|`` might hold a special token and is passed on unchanged.
    """

    def __init__(self, path: str, most_words: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most_words = most_words
        self.tails = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) if x else np.zeros(0, np.uint32) for x in ("", ".", ",")]
        self.clear()

    def clear(self) -> None:
        """Forgets all words. A word is known by 128 bits of a hash: ``keys`` in order, ``checks`` and ``numbers`` beside them."""
        self.keys, self.checks, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.lengths = np.concatenate(self.tails), np.array([len(x) for x in self.tails], np.int32)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each of the distinct ``words`` in the table of ids; new words are encoded."""
        if len(self.keys) > self.most_words:
            self.clear()
        raw = words.cast(pa.binary())
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw.to_pylist())), "<u8").reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.keys, digests[:, 0]), max(0, len(self.keys) - 1))
        known = (self.keys[at] == digests[:, 0]) & (self.checks[at] == digests[:, 1]) if len(self.keys) else np.zeros(len(words), bool)
        new = np.flatnonzero(~known)
        out = np.empty(len(words), np.int32)
        out[known] = self.numbers[at[known]]
        if len(new):
            fresh = words.take(pa.array(new))
            kinds = np.zeros(len(new), np.int64)
            for kind, pattern in enumerate(RUNS_OF, 1):
                kinds[pc.match_substring_regex(fresh, pattern).to_numpy(zero_copy_only=False)] = kind
            kinds[pc.match_substring(fresh, "<|").to_numpy(zero_copy_only=False)] = 0
            ids, lengths, places = [self.flat], [self.lengths], []
            for kind in range(len(RUNS_OF) + 1):
                places.append(np.flatnonzero(kinds == kind))
                group = fresh.take(pa.array(places[-1]))
                for k in range(0, len(group), 4000):  # the tokenizer's results are many times larger than their ids
                    flat, count = self._in_rows(group.slice(k, 4000).to_pylist(), kind) if kind else self._one_by_one(group.slice(k, 4000).to_pylist())
                    ids.append(flat)
                    lengths.append(count)
            new = new[np.concatenate(places)]
            out[new] = np.arange(len(self.lengths), len(self.lengths) + len(new))
            self.flat, self.lengths = np.concatenate(ids), np.concatenate(lengths)
            places = np.searchsorted(self.keys, digests[new, 0])
            order = np.argsort(digests[new, 0], kind="stable")
            self.checks = np.insert(self.checks, places[order], digests[new, 1][order])
            self.numbers = np.insert(self.numbers, places[order], out[new][order])
            self.keys = np.insert(self.keys, places[order], digests[new, 0][order])
        return out

    def _in_rows(self, words: list[str], runs: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of so many runs, and how many each has; a run ends where a token ends a word, so many words go in one text."""
        lines = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.final[ids])[runs - 1 :: runs]
        assert len(ends) == len(words)
        return ids, np.diff(ends, prepend=-1).astype(np.int32)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int32, len(ids))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        coded = words.dictionary_encode()
        raw = coded.dictionary.cast(pa.string())
        special = pc.match_substring(raw, "<|")
        plain = pc.if_else(special, raw, pc.ascii_lower(raw))
        stem = pc.ascii_rtrim(plain, characters=".,")
        single = pc.equal(pc.subtract(pc.binary_length(plain), pc.binary_length(stem)), 1)
        cut = pc.and_(pc.and_(single, pc.invert(special)), pc.match_substring_regex(stem, "[0-9a-z]$"))
        stem = pc.if_else(cut, stem, plain).dictionary_encode()
        tail = pc.if_else(cut, pc.if_else(pc.ends_with(plain, "."), 1, 2), 0).to_numpy(zero_copy_only=False)
        number = self._numbers(stem.dictionary)[stem.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
        pair = np.stack([number, tail.astype(np.int32)], 1)[coded.indices.to_numpy()].ravel()
        begin = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        lengths = self.lengths[pair]
        ends = np.cumsum(lengths, dtype=np.int32)
        places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        places += np.repeat(begin[pair] - (ends - lengths), lengths)
        return self.flat[places], lengths.reshape(-1, 2).sum(1)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) with the largest sum up to ``capacity``; longer lengths first."""
    if capacity <= 0:
        return {}
    bits, steps, full = 1, [], (1 << capacity + 1) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            after = (bits | bits << length) & full
            if after == bits:
                break
            steps.append((length, bits))
            bits = after
        if bits >> capacity & 1:
            break
    reached, taken = bits.bit_length() - 1, defaultdict(int)
    for length, before in reversed(steps):
        if not before >> reached & 1:
            taken[length] += 1
            reached -= length
    return dict(taken)


class Pool:
    """Remainders by length. A remainder is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int):
        self.window, self.by_length, self.counts, self.total = window, defaultdict(list), {}, 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_length[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.total += n

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        self.total -= n
        return self.by_length[n].pop()

    def next_window(self) -> list[tuple]:
        """Remainders that fill one window: exactly, while the pool has as many ids."""
        longest = max(self.counts)
        out = [self.take(longest)]
        room = self.window - longest
        for n, times in fill(self.counts, room).items():
            out += [self.take(n) for _ in range(times)]
            room -= n * times
        if room and self.counts:
            doc, start, ids, total = self.take(min(n for n in self.counts if n > room) if any(n > room for n in self.counts) else max(self.counts))
            out.append((doc, start, ids[:room], total))
            if len(ids) > room:
                self.add((doc, start + room, ids[room:], total))
        return out


def _sequences(texts: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """texts: (doc_id, ids). Each sequence is a list of pieces (doc_id, start, ids, doc_tokens)."""
    pool = Pool(window)
    for doc, ids in texts:
        n = len(ids)
        for at in range(0, n - window + 1, window):
            yield [(doc, at, ids[at : at + window], n)]
        if n % window:
            pool.add((doc, n - n % window, ids[n - n % window :].copy(), n))
        if pool.total > POOL_HIGH:
            while pool.total > POOL_LOW:
                yield pool.next_window()
    while pool.total >= window:
        yield pool.next_window()
    rest = [pool.take(n) for n in sorted(pool.counts, reverse=True) for _ in range(pool.counts[n])]
    left = sum(len(x[2]) for x in rest)
    while left:  # the tail, in powers of two
        room, sequence = 1 << left.bit_length() - 1, []
        left -= room
        while room:
            doc, start, ids, n = rest.pop(0)
            sequence.append((doc, start, ids[:room], n))
            if len(ids) > room:
                rest.insert(0, (doc, start + room, ids[room:], n))
            room -= len(sequence[-1][2])
        yield sequence


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``window`` ids, with ``ids`` as little-endian unsigned 32-bit values.

    tokenizer: path of a word-level BPE file that all executors can read (it comes with the public tokenizers' package).
    Null and empty texts are the end id alone. Rows that repeat a doc_id, or have none, are documents of their own, and
    equal rows or lengths may be placed in any order. A text of any length is cut into as many windows as it fills.
    An empty table gives no rows. Only doc_id and text are read, so other columns don't matter.
    Sequence ids hold the number of the task's partition in their upper bits; a task that is run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32

        def texts() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    first, words = word_lists(part["text"])
                    ids, lengths = encoder.encode(words)
                    ends = np.concatenate([[0], np.cumsum(lengths)])[first]
                    for doc, a, b in zip(part["doc_id"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        yield doc, np.append(ids[a:b], np.uint32(end_id))

        def rows(found: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*found, strict=True)
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        found, held = [], 0
        for number, sequence in enumerate(_sequences(texts(), window)):
            offset = 0
            for doc, start, ids, total in sequence:
                found.append((doc, start, ids, total, base + number, offset))
                offset += len(ids)
            held += offset
            if held >= OUTPUT:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)
        del encoder
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
