"""Collocations against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import phrases


def brute(rows, threshold, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= threshold}
        inside = {p[i:j] for p, a in kept.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[p[i:j]]}
        found = []
        for p, a in kept.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)] + ["É", "ß", "日本", "A-b", "'s", "Z"]
    rows = []
    for k in range(300):
        text = "".join(rng.choice(words[: rng.randrange(2, 46)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(0, 60)))
        rows.append((text, ("en", "de", None, "en", "en")[k % 5]))
    rows += [(None, "en"), ("", None), ("  \t\n", "xx"), ("w1 " * 500, "en"), ("One Two Three Four Five Six. " * 30, "fr")]
    rows += [("the same passage of seven words here", "en")] * 25
    return rows


@pytest.mark.parametrize(("cycle", "threshold"), [(1, 20), (3, 6)])
def test_brute(spark, cycle, threshold):
    rows = corpus()
    df = spark.createDataFrame([(*r, k, "x", 0, 1) for k, r in enumerate(rows)], "text string, lang string, doc_id long, phrase string, level int, shard int").repartition(3)
    found = sorted(map(tuple, phrases.collocations(df, threshold=threshold, cycle=cycle).collect()))
    assert found == brute(rows, threshold)


def test_few_slots_and_few_rows(spark, monkeypatch):
    """A table of 16 slots is full at once: more is counted than need be, with the same result."""
    monkeypatch.setattr(phrases, "WAITING", 50)
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert sorted(map(tuple, phrases.collocations(df, threshold=20, most=7, cycle=2, slot_bits=4).collect())) == brute(rows, 20, 7)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_a_task_gives_a_phrase_once(spark, monkeypatch):
    """What a task has counted is merged, not given each time that enough waits; beyond KEPT it is given in parts."""
    monkeypatch.setattr(phrases, "WAITING", 50)
    monkeypatch.setattr(phrases, "SLICE", 500)
    df = spark.createDataFrame(corpus(), "text string, lang string").coalesce(1)
    table = phrases.packed_table(df, 1).coalesce(1)
    assert table.count() > 20
    found = phrases.scan(table, 0, np.zeros(1 << 4, np.uint8), 5, 1, 4).collect()
    assert len({(r.hash, r.level) for r in found}) == len(found) > 1000
    monkeypatch.setattr(phrases, "KEPT", 100)
    parts = phrases.scan(table, 0, np.zeros(1 << 4, np.uint8), 5, 1, 4)
    assert parts.count() > len(found)
    assert sorted(parts.groupBy("hash", "level").sum("n").collect()) == sorted((r.hash, r.level, r.n) for r in found)
    assert sorted(map(tuple, phrases.collocations(df, threshold=20, cycle=2).collect())) == brute(corpus(), 20)


def test_slices_go_on_in_the_next_batch(spark, monkeypatch):
    """Spark hands over small batches, whatever the session's setting, and the slices are the same."""
    monkeypatch.setattr(phrases, "SLICE", 2000)
    key, records = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([*corpus(), (None, None), ("w1 " * 3000, "en"), ("a b", "en")], "text string, lang string").coalesce(1)
    before, whole = spark.conf.get(key), sorted(phrases.packed_table(df, 2).collect())
    assert len(whole) > 10 and spark.conf.get(key) == before
    spark.conf.set(records, 7)
    try:
        assert sorted(phrases.packed_table(df, 2).collect()) == whole
    finally:
        spark.conf.unset(records)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    with phrases.small_batches(spark, 1000):
        assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) < df.count() // 5
    assert spark.conf.get(key) == before


def test_close_hashes_are_told_apart():
    known = np.array([5, 1 << 63, (1 << 63) + 2, 2**64 - 1], np.uint64)
    keys = np.array([0, 5, (1 << 63) + 1, (1 << 63) + 2, 2**64 - 2, 2**64 - 1], np.uint64)
    at, there = phrases.places(known, keys)
    assert at.tolist() == [0, 0, 2, 2, 3, 3] and there.tolist() == [False, True, False, True, False, True]
    counts = phrases.Counts()
    counts.add(known, np.arange(1, 5))
    counts.merge()
    counts.add(keys, np.full(6, 10))
    counts.merge()
    assert counts.keys.tolist() == sorted({*known.tolist(), *keys.tolist()}) and counts.numbers.tolist() == [10, 11, 2, 10, 13, 10, 14]


def test_products_beyond_64_bits(spark):
    schema = "lang string, phrase string, level int, f long"
    f = 3 * 10**15
    known = spark.createDataFrame([("en", "a b", 2, f), ("en", "a", 1, f + 1), ("en", "b", 1, f + 7)], schema)
    n = 9 * 10**14
    row = phrases.scored(known, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * f * n // ((f + 1) * (f + 7)) and (row.l, row.r) == (f + 1, f + 7)


def test_words_that_name_a_language(spark):
    """A word may be the name of its own language or of another one, whose words may name the first."""
    rows = [("de la casa de la villa, es de la casa", "es")] * 7 + [("es war so und es war so, de es", "de")] * 7
    rows += [("es es es, und und, de es", "es")] * 4 + [("und so und und und", None)] * 6 + [("de und de de", "de")] * 5
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert sorted(map(tuple, phrases.collocations(df, threshold=5, cycle=2).collect())) == brute(rows, 5)


@pytest.mark.parametrize("many", [3, 70_000])
def test_words_are_numbered_once(many):
    """A slice's row gives back words, pieces and languages; codes have 32 bits where 16 are too few."""
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{k}" for k in range(many)) + " A, b\tw1", None, "", "w1. .W1 é"], "lang": ["en", "en", None, None]})
    row = pa.RecordBatch.from_pylist([phrases.packed(batch)])
    words = phrases.Slice(row, 0)
    texts = words.texts([words.codes]).to_pylist()
    assert texts == [f"w{k}" for k in range(many)] + ["a", "b", "w1", "w1", "w1", "é"]
    assert np.flatnonzero(words.opens).tolist() == [0, many + 1, many + 3, many + 4] and words.codes.itemsize == (2 if many < 1 << 16 else 4)
    assert len(words.hashes) == many + 4 and (row["langs"][0].as_py(), row["sizes"][0].as_py()) == (["en", "und"], [many + 3, 3])
