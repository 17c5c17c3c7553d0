"""Phrases that stand together more often than their parts would, by dynamic itemset counting.

The documents' words are numbered once, in slices; the slices are dealt into shards that are scanned in a cycle. Words are counted from the first scan on; a longer
phrase becomes active at the scan after both its subphrases (without its last, and without its first word) have
reached the threshold, so phrases of all lengths are counted in the same scans. Each is counted for one whole cycle
from there, so its count is that of all documents. What has reached the threshold, and when, is known to the tasks by a
table of bytes with a fixed number of slots: two phrases of one slot only mean that some phrase is counted that needn't
be, or earlier. A slot never changes once it is set, so every active phrase still sees each shard exactly once.

Phrases are known by a 64-bit hash of their language and words; with ten thousand million different phrases, the chance
that any of a million frequent ones shares its hash with another is below a thousandth. A last pass finds the texts: each
phrase is looked for in a sixteenth of the slices, which its hash names, and what isn't met there in all.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, shared_folder, slices, written

#: Longest phrase, occurrences that make a candidate, shards of a cycle.
LONGEST, THRESHOLD, SHARDS = 5, 100, 2
#: Parts of the table by which texts are looked up.
SPOTS = 16
#: Bits of a slot's number; the value of a slot that nothing has reached.
SLOT_BITS, NEVER = 24, 255
#: Hashes that wait in a task to be counted together, different ones that it keeps (16 bytes each), and rows that it gives at once.
WAITING, KEPT, ROWS = 250_000, 3_000_000, 50_000
#: Bytes of text that a task has as words at once, about.
SLICE = 1 << 20
#: Bytes of rows that Spark hands to a task's Python at once, about; larger buffers stay with the executor when they are free again.
BATCH = 4 << 20

SEPARATORS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
KIND_OF = np.zeros(256, np.uint8)
KIND_OF[list(BLANKS)] = 1
KIND_OF[list(SEPARATORS)] = 2


def packed(batch: pa.RecordBatch) -> dict | None:
    """The words of texts as a row of the scans' table: the distinct ones (of a language) once, and which of them stands where.

    hashes: of the distinct words, by their language too; codes: the number of each word, of 16 bits where that is enough;
    opens: bits of the words that begin a piece; owners, names: language (its place in langs) and text of the distinct words,
    joined by a space; sizes: words of each of langs. None without words.
    """
    texts = pc.ascii_lower(pc.fill_null(batch["text"], "").cast(pa.string()))
    langs = pc.fill_null(batch["lang"], "und").cast(pa.string()).dictionary_encode()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KIND_OF[data]
    inside = kind == 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    opening = offsets[:-1][offsets[:-1] < len(data)]
    fresh[opening] = inside[opening]
    begins = np.flatnonzero(fresh)
    if not len(begins):
        return None
    breaks = (kind == 2).astype(np.int32)
    breaks[opening] += 1
    opens = np.diff(np.cumsum(breaks, dtype=np.int32)[begins], prepend=-1) != 0
    before = np.cumsum(inside, dtype=np.int32) - inside  # word bytes before each byte
    bounds = np.append(before[begins], np.int32(np.count_nonzero(inside))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data[inside])).dictionary_encode()
    lang = langs.indices.to_numpy()[np.searchsorted(offsets, begins, side="right") - 1].astype(np.int64)
    raw = words.dictionary.cast(pa.binary()).to_pylist()
    pair = lang * len(raw) + words.indices.to_numpy()
    if len(langs.dictionary) * len(raw) <= 4 * len(pair) + SLICE:
        there = np.zeros(len(langs.dictionary) * len(raw), bool)
        there[pair] = True
        distinct, codes = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[pair]
    else:
        distinct, codes = np.unique(pair, return_inverse=True)
    owners, own = distinct // len(raw), distinct % len(raw)
    names = langs.dictionary.to_pylist()
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in names], np.uint64)  # 1: other than the hash of a word that names a language
    hashes = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))[own] ^ seeds[owners])
    return {
        "hashes": hashes.tobytes(), "codes": codes.astype(code_type(len(hashes))).tobytes(), "opens": np.packbits(opens).tobytes(), "owners": owners.astype(np.int32).tobytes(),
        "names": b" ".join(map(raw.__getitem__, own.tolist())), "langs": names, "sizes": np.bincount(lang, minlength=len(names)).tolist(),
    }


def code_type(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """What runs within it gets batches of about ``size`` bytes; then the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def packed_table(docs: DataFrame, cycle: int) -> DataFrame:
    """The words of docs (text, lang) in rows of about SLICE bytes of text each, dealt into shards and spots."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []
        for batch in batches:
            found = [part for one in pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches() for part in slices(one, "text", SLICE)]
            yield from found[:-1]
            rest = found[-1:]  # goes on in the next batch
        yield from rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for part in parts(batches):
            row = packed(part)
            if row:
                yield pa.RecordBatch.from_pylist([row | {"spot": number // cycle % SPOTS, "shard": number % cycle}], schema)
                number += 1
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    schema = pa.schema({**dict.fromkeys(("hashes", "codes", "opens", "owners", "names"), pa.binary()), "langs": pa.list_(pa.string()), "sizes": pa.list_(pa.int64()), "spot": pa.int32(), "shard": pa.int32()})
    types = "hashes binary, codes binary, opens binary, owners binary, names binary, langs array<string>, sizes array<long>, spot int, shard int"
    path = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    with small_batches(docs.sparkSession):
        docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, types).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(types).parquet(path)


class Slice:
    """A row of the scans' table: its distinct hashes and its words, as numbers of them."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.get = lambda name, kind: np.frombuffer(batch[name][row].as_buffer(), kind)
        self.hashes = self.get("hashes", np.uint64)
        self.codes = self.get("codes", code_type(len(self.hashes)))
        self.opens = np.unpackbits(self.get("opens", np.uint8), count=len(self.codes)).view(bool)

    def grams(self, told: np.ndarray, longest: int, tell: Callable) -> None:
        """Calls tell(level, first words, hashes, numbers) for the phrases of two words and more, level by level.

        ``told`` has a number below NEVER for each distinct word that may be in a phrase, and tell returns such numbers of
        its phrases. A longer phrase is looked at only if both its parts have one; its number here is the larger one.
        """
        told = told[self.codes]
        at = np.flatnonzero(told < NEVER)
        told, sums, factor = told[at], self.hashes[self.codes[at]], 1
        for level in range(2, longest + 1):
            pairs = at[1:] == at[:-1] + 1
            if level == 2:
                pairs &= ~self.opens[at[1:]]
            pairs = np.flatnonzero(pairs)
            if not len(pairs):
                return
            factor = factor * 0x9E3779B97F4A7C15 % 2**64
            at, told = at[pairs], np.maximum(told[pairs], told[pairs + 1])
            sums = sums[pairs] + self.hashes[self.codes[at + level - 1]] * np.uint64(factor)
            told = tell(level, at, mix(sums), told)
            if level < longest:
                those = np.flatnonzero(told < NEVER)
                at, told, sums = at[those], told[those], sums[those]

    def texts(self, words: list[np.ndarray]) -> pa.Array:
        """The n-th of the distinct words of each list, joined by a space."""
        names = self.get("names", np.uint8)
        ends = np.append(np.flatnonzero(names == 0x20), len(names))
        starts = np.append(0, ends[:-1] + 1)
        lengths = ends - starts
        size = sum(lengths[x] for x in words) + len(words) - 1
        bounds = np.append(0, np.cumsum(size)).astype(np.int64)
        out = np.full(int(bounds[-1]), 0x20, np.uint8)
        to = bounds[:-1].copy()
        for x in words:
            many = lengths[x]
            spread = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out[np.repeat(to, many) + spread] = names[np.repeat(starts[x], many) + spread]
            to += many + 1
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))


def slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def second_slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand, or would stand, in ascending ones, and which are there."""
    at = np.searchsorted(known, keys)
    return at, known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


class Counts:
    """Numbers of equal hashes, in ascending order; what is added waits until it is merged."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers, self.waiting, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Of distinct hashes."""
        self.waiting.append((hashes, counts))
        self.n += len(hashes)

    def merge(self) -> None:
        if not self.n:
            return
        keys, back = np.unique(np.concatenate([x for x, _ in self.waiting]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([n for _, n in self.waiting]), len(keys)).astype(np.int64)
        self.waiting, self.n = [], 0
        at, there = places(self.keys, keys)
        self.numbers[at[there]] += counts[there]
        self.keys, self.numbers = np.insert(self.keys, at[~there], keys[~there]), np.insert(self.numbers, at[~there], counts[~there])


def scan(shard: DataFrame, step: int, since: np.ndarray, longest: int, cycle: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """hash, level and n of the phrases of a shard that are active at a step; ``since`` has the first step of what goes on from each slot."""

    packed = zlib.compress(since.tobytes(), 1)  # mostly empty, so far smaller than its slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = np.frombuffer(zlib.decompress(packed), np.uint8)
        found = {level: Counts() for level in range(1, longest + 1)}

        def tell(level: int, at: np.ndarray, hashes: np.ndarray, begun: np.ndarray) -> np.ndarray:
            active = (begun <= step) & (begun.astype(np.int16) + cycle > step)
            if active.any():
                found[level].add(*np.unique(hashes[active], return_counts=True))
            # not before it is counted itself, also where its slot was set for another phrase
            return np.maximum(since[slot(hashes, slot_bits)], begun) if level < longest else begun

        for batch in batches:
            for row in range(batch.num_rows):
                words = Slice(batch, row)
                if step < cycle:
                    found[1].add(words.hashes, np.bincount(words.codes, minlength=len(words.hashes)))
                if longest > 1:
                    words.grams(since[slot(words.hashes, slot_bits)], longest, tell)
                if sum(counts.n for counts in found.values()) > WAITING:
                    max(found.values(), key=lambda counts: counts.n).merge()
                if sum(len(counts.keys) for counts in found.values()) > KEPT:
                    level = max(found, key=lambda k: len(found[k].keys))
                    yield from rows(level, found[level])
        for level, counts in found.items():
            yield from rows(level, counts)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    def rows(level: int, counts: Counts) -> Iterator[pa.RecordBatch]:
        counts.merge()
        keys, n = counts.keys, counts.numbers
        counts.clear()
        for k in range(0, len(keys), ROWS):
            some = slice(k, k + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(np.full(len(keys[some]), level), pa.int32()), pa.array(n[some])], names=["hash", "level", "n"])

    return shard.select("hashes", "codes", "opens").mapInArrow(run, "hash long, level int, n long")


def packed_slots(hashes: DataFrame) -> np.ndarray:
    """The hashes' slots, of both kinds, each once for a task: at most 2^slot_bits numbers of 4 bytes from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint32)
        for batch in batches:
            own = np.union1d(own, batch["slot"].to_numpy().astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["slots"])

    found = hashes.select("slot").distinct().mapInArrow(run, "slots binary").collect()
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.slots, np.uint32) for r in found)])).astype(np.int64)


def count(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, cycle: int = SHARDS, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(the slices of all shards; hash, level and n of all phrases with at least ``threshold`` occurrences in one language).

    ``docs`` has text and lang. A phrase of the result has been counted over each shard once.
    """
    spark, table = docs.sparkSession, packed_table(docs, cycle)
    since = np.full(1 << slot_bits, NEVER, np.uint8)
    state = spark.range(0).select(F.col("id").alias("hash"), F.lit(0).alias("level"), F.col("id").alias("n"), F.lit(0).alias("begun"), F.lit(False).alias("reached"))
    done, step, last = [], 0, 0
    while step < cycle or step <= last + cycle:
        shard = table.where(F.col("shard") == step % cycle)
        shard = shard.coalesce(max(spark.sparkContext.defaultParallelism, -(-shard.rdd.getNumPartitions() // 2)))  # what two parts share is summed before the shuffle
        fresh = scan(shard, step, since, longest, cycle, slot_bits)
        known = state.unionByName(fresh.select("hash", "level", "n", F.lit(step).alias("begun"), F.lit(False).alias("reached")))
        # a task's rows are summed already, so they are dealt out as they are: a map of them in the JVM would take ten times the room
        summed = known.repartition("hash", "level").groupBy("hash", "level").agg(F.sum("n").alias("n"), F.min("begun").alias("begun"), F.max("reached").alias("reached"))
        with small_batches(spark):
            summed = written(summed.withColumn("now", (F.col("n") >= threshold) & ~F.col("reached")))
        new = summed.where("now")
        slots = packed_slots(new.where(F.col("level") < longest).select(F.shiftrightunsigned("hash", 64 - slot_bits).alias("slot")))
        if (since[slots] > step + 1).any():
            since[slots] = np.minimum(since[slots], step + 1)
            last = step
        # begun is the step at which it was first seen, not before it became active: a cycle after that its count is whole
        over = F.col("begun") + cycle - 1 <= step
        done.append(summed.where(over & (F.col("n") >= threshold)).select("hash", "level", "n"))
        state = summed.where(~over).select("hash", "level", "n", "begun", (F.col("reached") | F.col("now")).alias("reached"))
        step += 1
    every = state.where(F.col("n") >= threshold).select("hash", "level", "n")
    for more in done:
        every = every.unionByName(more)
    return table, every


def packed_bits(found: DataFrame, slot_bits: int) -> bytes:
    """The slots, of both kinds, of the phrases found."""
    some = np.zeros(1 << slot_bits, bool)
    some[packed_slots(found.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - slot_bits), F.col("hash").bitwiseAND((1 << slot_bits) - 1))).alias("slot")))] = True
    return zlib.compress(np.packbits(some).tobytes(), 1)


def texts_of(table: DataFrame, every: bytes, missed: bytes | None, longest: int, slot_bits: int) -> DataFrame:
    """hash, lang and phrase of the phrases found, whose bits are ``every``, and of few others.

    A phrase is only looked for in the rows of the spot that its hash names; those with bits in ``missed``, if given, in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sought = (np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).view(bool) if x else None for x in (every, missed))
        known = lambda bits, hashes: bits[slot(hashes, slot_bits)] & bits[second_slot(hashes, slot_bits)]
        told, out = np.zeros(0, np.uint64), []
        for batch in batches:
            for row in range(batch.num_rows):
                words, spot = Slice(batch, row), np.uint64(batch["spot"][row].as_py())
                langs, owners = batch["langs"][row].values, words.get("owners", np.int32)

                def tell(level: int, at: np.ndarray, hashes: np.ndarray, _: np.ndarray | None = None) -> np.ndarray:
                    nonlocal told
                    there = known(bits, hashes)  # all parts of a phrase are there too
                    own = np.flatnonzero(there & (known(sought, hashes) if missed else hashes >> np.uint64(8) & np.uint64(SPOTS - 1) == spot))  # noqa: B023
                    keys, first = np.unique(hashes[own], return_index=True)
                    fresh = np.flatnonzero(~places(told, keys)[1])
                    if len(fresh):
                        told = np.union1d(told, keys[fresh]) if len(told) < WAITING else keys
                        which = at[own[first[fresh]]]
                        parts = [which] if level == 1 else [words.codes[which + j] for j in range(level)]  # noqa: B023
                        out.append(pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), langs.take(pa.array(owners[parts[0]])), words.texts(parts)], names=["hash", "lang", "phrase"]))  # noqa: B023
                    return np.where(there, np.uint8(0), np.uint8(NEVER))

                words.grams(tell(1, np.arange(len(words.hashes)), words.hashes), longest, tell)
                yield from out
                out.clear()
        pa.default_memory_pool().release_unused()

    named = table.select("hashes", "codes", "opens", "owners", "names", "langs", "spot").mapInArrow(run, "hash long, lang string, phrase string")
    with small_batches(table.sparkSession):
        return written(named.distinct())


def with_texts(table: DataFrame, found: DataFrame, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, level, f of the phrases found; lang and n, its words)."""
    longest, every = found.agg(F.max("level")).first()[0] or 0, packed_bits(found, slot_bits)
    names = texts_of(table, every, None, longest, slot_bits)
    missed = written(found.join(names, "hash", "left_anti"))
    if not missed.isEmpty():
        more = texts_of(table, every, packed_bits(missed, slot_bits), longest, slot_bits)
        names = names.unionByName(more.join(missed, "hash", "left_semi"))
    sizes = table.select(F.explode(F.arrays_zip("langs", "sizes")).alias("of")).groupBy(F.col("of.langs").alias("lang")).agg(F.sum("of.sizes").alias("n"))
    return written(found.join(names, "hash").select("lang", "phrase", "level", F.col("n").alias("f"))), written(sizes)


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of two words and more, at the cut that scores lowest."""
    cut = F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("k")
    cuts = phrases.where("level > 1").select("lang", "phrase", F.col("f").alias("a"), cut)
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    known = phrases.select("lang", "phrase", "f")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    score = F.expr("(cast(a as decimal(19, 0)) * cast(n as decimal(15, 0)) * cast(1000 as decimal(4, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, most: int = 2000, longest: int = LONGEST, threshold: int = THRESHOLD, cycle: int = SHARDS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The first ``most`` phrases of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Null and empty texts have no words; a null lang is ``und``. Words are cut from the lower-cased (A-Z) text at spaces and
    tabs, phrases don't reach across line ends or ``.,;:!?``. A phrase within a longer one of equal frequency goes. Ties of
    the score go by frequency, then by the phrase's bytes. Rows are documents of their own, also equal ones. A very long
    text is read whole, in one task. An empty table has no phrases. Columns of other names aren't read.
    """
    table, found = count(docs, longest, threshold, cycle, slot_bits)
    phrases, sizes = with_texts(table, written(found), slot_bits)
    without = lambda side: F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)" if side else "substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
    longer = phrases.where("level > 2").select("lang", F.explode(F.array(without(0), without(1))).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored(phrases, sizes).join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
