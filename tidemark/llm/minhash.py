"""Near-duplicate documents with HyperMinHash sketches, verified on full shingle sets.

A document's shingles are hashed to 256 buckets. A bucket's register holds the leading-zero count of the smallest
hash in it and ten mantissa bits, 16 bits together; empty registers are filled from others by fixed hash walks, so
short texts compare too. Bands of six registers are the candidate keys: documents of similarity 0.8 miss all of the
42 bands about three times in a million. The estimate from equal registers is corrected for chance collisions, and
drops a pair only where it is six standard errors below the threshold; pairs that are left are verified on full sets.

Texts with equal sets are one class from the start. In a band, members are compared with one centre (the one whose
bands are the fullest, as those of an original are among its copies; it may be one that another band of a member has,
so that a crowd has few centres). With |C| shingles in the centre, and a member
that lacks R of them and adds A others, the member's cost is 100 R + percent A, and two members x and y of which s
differences are common have the similarity asked for exactly if

    (100 + percent) s >= cost(x) + cost(y) - (100 - percent) |C|.

A member is linked with the centre if its cost is at most (100 - percent) |C|. So a member that isn't must share
differences with every text that it is linked with, and since differences are few and mostly a text's own, an exact
prefix-filter join on them (rarest first, with a positional filter) finds its links without pairs within the crowd:
see ``met``. By the triangle inequality, members of a similarity under ``reach`` to the centre have no link with those
that are linked with it. So the latter leave the band; where what is left has several components, the next round takes
another centre, and the last one has no reach and compares all that is left, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, gram_hashes, mix, slices, word_hashes, word_lists, written

REGISTERS, MANTISSA, BANDS, ROWS = 256, 10, 42, 6
#: Share of registers that agree by chance, times 2**(mantissa bits) (a constant of the HyperMinHash paper).
CHANCE = 0.169919487159739
EMPTY = 0xFFFF
#: Where an empty register looks for a value, attempt by attempt.
WALKS = np.random.default_rng(7).integers(0, REGISTERS, (96, REGISTERS))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Ascending hashes of each text's distinct shingles; fewer words than a shingle are one shingle, no words none."""
    first, words = word_lists(texts, lower=True)
    hashed = word_hashes(words)
    grams = gram_hashes(hashed, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(gram_hashes(np.append(hashed[a:b], np.uint64(b - a)), b - a + 1) if b > a else np.zeros(0, np.uint64))
    return out


def set_hash(values: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(values + np.uint64(1)), dtype=np.uint64) + np.uint64(len(values))]))[0].astype(np.int64))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each non-empty set."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    bucket = (flat >> np.uint64(56)).astype(np.int64)
    cell = doc * REGISTERS + bucket
    smallest = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))  # hashes ascend within a document
    fraction, exponent = np.frexp((flat[smallest] & np.uint64((1 << 56) - 1)).astype(np.float64) + 1.0)
    found = np.full(len(sets) * REGISTERS, EMPTY, np.uint16)
    found[cell[smallest]] = (np.clip(57 - exponent, 0, 62) << MANTISSA) + np.floor((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    found = found.reshape(-1, REGISTERS)
    out = found.copy()
    for walk in WALKS:
        if not (gap := out == EMPTY).any():
            return out
        out = np.where(gap, found[:, walk], out)
    for shift in range(1, REGISTERS):  # few values: the next one
        if not (gap := out == EMPTY).any():
            break
        out = np.where(gap, np.roll(found, -shift, axis=1), out)
    return out


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cid (a hash of the whole set) and registers of each row; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = shingle_sets(part["text"], shingle)
                full = [x for x in sets if len(x)]
                rows = iter(registers(full) if full else ())
                blobs = [next(rows).tobytes() if len(x) else None for x in sets]
                columns = [part["doc_id"], part["text_hash"], pa.array([len(x) for x in sets], pa.int64()), pa.array([set_hash(x) if len(x) else None for x in sets], pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "cid", "registers"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, cid long, registers binary")


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of two register columns, corrected for chance collisions."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (x, y))
        chance = CHANCE / (1 << MANTISSA)
        return pd.Series(np.maximum(0.0, ((left == right).mean(1) - chance) / (1 - chance)))

    return run(a, b)


def full_registers(n: Column) -> Column:
    """Registers that a set of ``n`` shingles fills, as expected: the sample that an estimate rests on."""
    return REGISTERS * (1 - F.exp(-n / REGISTERS))


def compared(pairs: DataFrame, facts: DataFrame, texts: DataFrame, shingle: int, percent: int, reach: int) -> DataFrame:
    """a, b, cost, slack and diff (the shingles that one of both has) of pairs of a class and its centre with a similarity of ``reach`` percent or more.

    slack: the largest cost of a link with the centre. facts: (cid, n, registers), texts: (cid, text). Pairs go by the
    registers first, unless all are in reach.
    """
    near = pairs
    if reach:
        a = facts.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("registers_a"))
        b = facts.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("registers_b"))
        least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        known = pairs.join(a, "a").join(b, "b").where(100 * least >= reach * most)
        error = F.sqrt(reach / 100 * (1 - reach / 100) / full_registers(least))
        near = known.where(estimate(F.col("registers_a"), F.col("registers_b")) >= reach / 100 - 6 * error).select("a", "b")
    with_a = near.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            for part in slices(batch, "text_b", 2 << 20):
                found = []
                sets = shingle_sets(part["text_a"], shingle)
                for i, (x, y) in enumerate(zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True)):
                    if y != last:  # rows come by b
                        last, last_set = y, shingle_sets(part["text_b"].slice(i, 1), shingle)[0]
                    if set_hash(sets[i]) != x or set_hash(last_set) != y:  # another text with that doc_id
                        last = None
                        continue
                    diff = np.setxor1d(sets[i], last_set, assume_unique=True)
                    common = (len(sets[i]) + len(last_set) - len(diff)) // 2
                    if 100 * common >= reach * (common + len(diff)):
                        found.append((x, y, 100 * (len(last_set) - common) + percent * (len(sets[i]) - common), (100 - percent) * len(last_set), diff))
                a, b, cost, slack, diffs = zip(*found, strict=True) if found else ((), (), (), (), ())
                ends = np.cumsum([0, *map(len, diffs)])
                flat = np.concatenate([np.zeros(0, np.uint64), *diffs]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, b, cost, slack)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["a", "b", "cost", "slack", "diff"])

    return both.mapInArrow(run, "a long, b long, cost long, slack long, diff array<long>").dropDuplicates(["a", "b"])


def met(found: DataFrame, percent: int, among: bool) -> DataFrame:
    """Links (a, b) that members which aren't linked with their centre have with members that are (b: the centre), and with ``among`` also among each other.

    found: as of ``compared``. Of each member, only the first differences by (members that have it, hash) are looked
    up: as many as leave too few for a link. Of a member's links with the centre's own, one is enough.
    """
    over = F.col("cost") > F.col("slack")
    least = found.groupBy("b").agg(F.min(F.when(over, F.col("cost"))).alias("least_over"), F.min("cost").alias("least")).where("least_over is not null")
    need = F.ceil((F.col("cost") + F.when(over, F.col("least")).otherwise(F.col("least_over")) - F.col("slack")) / (100 + percent))
    mixed = found.join(least, "b").withColumn("first", F.size("diff") - F.greatest(need, F.lit(1)) + 1).where("first > 0")
    items = mixed.select("a", "b", F.explode("diff").alias("item"))
    counts = items.groupBy("b", "item").agg(F.count("*").alias("n")).where("n > 1")
    shared = items.join(counts, ["b", "item"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("shared"))
    known = shared.join(mixed.select("a", "b", "cost", "slack", "first", F.size("diff").alias("size")), ["a", "b"])
    held = known.select("a", "b", "cost", "slack", F.transform("shared", lambda x: x["item"]).alias("shared"), (F.col("first") - F.col("size") + F.size("shared")).cast("int").alias("first")).where("first > 0").checkpoint()
    keys = held.select("*", F.posexplode(F.slice("shared", F.lit(1), F.col("first"))).alias("at", "item"))
    other = keys.select(*(F.col(c).alias(f"{c}_2") for c in ("a", "b", "cost", "shared", "at", "item")), over.alias("over_2"))
    asked = F.col("cost") + F.col("cost_2") - F.col("slack")
    left = F.least(F.size("shared") - F.col("at"), F.size("shared_2") - F.col("at_2"))
    fits = (F.col("b") == F.col("b_2")) & (F.col("item") == F.col("item_2")) & ((100 + percent) * left >= asked) & ((100 + percent) * F.size(F.array_intersect("shared", "shared_2")) >= asked)
    links = keys.where(over).join(other.where("not over_2"), fits, "left_semi").select("a", "b")
    if among:
        links = links.unionByName(keys.where(over).join(other.where("over_2"), fits & (F.col("a") < F.col("a_2"))).select("a", F.col("a_2").alias("b")))
    return links.distinct()


def narrow(df: DataFrame, rows: int, per: int = 200_000) -> DataFrame:
    """A table of about so many rows in no more partitions than it needs, so that small tables don't write many small files."""
    return df.coalesce(max(2, rows // per))


def components(edges: DataFrame) -> DataFrame:
    """cid and comp (the smallest cid reachable) of every end of an edge; each round's labels are checkpointed."""
    size = edges.count()
    edges = narrow(edges, size)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = narrow(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("cid"), F.least("a", "low").alias("comp")), size).checkpoint()
    while True:
        ends = labels.select(F.col("cid").alias("b"), "comp")
        low = narrow(both.join(ends, "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("low")), size)
        nearer = narrow(labels.join(low, "cid").select("cid", F.least("comp", "low").alias("next"), F.col("comp").alias("was")), size)
        jump = labels.select(F.col("cid").alias("next"), F.col("comp").alias("far"))
        after = narrow(nearer.join(jump, "next").select("cid", F.least("next", "far").alias("comp"), "was"), size).checkpoint()
        labels = after.drop("was")
        if after.where("comp != was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id = component_id) of each row.

    Words are lower-cased in A-Z. Fewer words than a shingle are one shingle; texts without words (null, empty, blank)
    link with nothing. Rows with one doc_id are judged each by its own text; text_hash (xxhash64) tells them apart. A row
    without a doc_id links with nothing, has no component_id and is kept. Equal rows have equal results. Texts are read
    whole, however long. An empty table gives no rows. Only doc_id and text are read, so other columns don't matter.
    Hot labels and centres are keys of joins that adaptive execution can split. ``rounds`` of centres are taken at most, whatever is left in the last one.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = sketch(texts.withColumn("text_hash", F.xxhash64("text")), shingle).checkpoint()
    known = sketches.where("cid is not null and doc_id is not null")
    classes = known.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).checkpoint()

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = classes.select("cid", "registers", band.alias("band")).select(F.xxhash64("band", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"), "cid")
    several = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = bands.join(several, "key").checkpoint()  # (key, cid, members), a few per document that has a near copy
    size = members.count()
    members = narrow(members, size)
    weight = narrow(members.groupBy("cid").agg(F.sum("members").alias("weight")), size)
    members = narrow(members.join(weight, "cid").select("key", "cid", "weight"), size).checkpoint()
    near = narrow(members.select("cid").distinct(), size).join(classes, "cid")
    facts = written(narrow(near.select("cid", "n", "registers"), size, 50_000))  # of candidates only, as their texts
    texts = written(narrow(texts.join(near.select("cid", F.col("rep").alias("doc_id")), "doc_id").select("cid", "text"), size, 50_000))

    edges, labels, now = None, None, members
    for k in range(rounds):
        last = k == rounds - 1
        best = lambda x: F.max(x).alias("centre")
        named = F.struct("weight", F.col("cid").alias("b"))
        seated = narrow(now.join(now.groupBy("key").agg(best(named)), "key"), size)
        chosen = seated.groupBy("cid").agg(best("centre"))  # bands of one crowd, and so each of its members, mostly share one
        shared = narrow(seated.select("key", "cid", "weight").join(chosen, "cid"), size).checkpoint()
        seated = narrow(shared.drop("centre").join(shared.groupBy("key").agg(best("centre")), "key"), size)
        seated = seated.select("key", "cid", "weight", "centre.b").where("cid != b").checkpoint()
        pairs = seated.select(F.col("cid").alias("a"), "b").distinct().checkpoint()
        n_pairs = pairs.count()
        if not n_pairs:
            break
        reach = 0 if last else max(0, 2 * percent - 100)
        found = narrow(compared(narrow(pairs, n_pairs, 5_000), facts, texts, shingle, percent, reach), n_pairs, 5_000).checkpoint()
        linked = found.where("cost <= slack").select("a", "b")
        own = narrow(linked.unionByName(narrow(met(found, percent, last), n_pairs, 50_000)), n_pairs).checkpoint()
        edges = own if edges is None else edges.unionByName(own)
        labels = components(edges)
        if last:
            break
        left = narrow(seated.join(linked.withColumnRenamed("a", "cid"), ["cid", "b"], "left_anti").select("key", "cid", "weight"), size)
        named = narrow(left.join(labels, "cid", "left").select("key", "cid", "weight", F.coalesce("comp", "cid").alias("comp")), size).checkpoint()
        open_keys = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        now = narrow(named.join(open_keys, "key").select("key", "cid", "weight"), size).checkpoint()

    if labels is None:
        labels = classes.select("cid", F.col("cid").alias("comp")).limit(0)
    low = classes.join(labels, "cid", "left").select("cid", "rep", F.coalesce("comp", "cid").alias("comp"))
    reached = low.join(low.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("cid", "component_id")
    own = F.col("doc_id").isNotNull()
    every = sketches.select("doc_id", "text_hash", "n_shingles", "cid").join(reached, "cid", "left")
    component = F.when(own, F.coalesce("component_id", "doc_id"))
    return every.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
