"""Each operator against brute force on edge cases: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, fingerprints, language, licenses, minhash, mixing, packing, quality, queries, rules, substrings, suffixes

from brute import brute_components, brute_repeats, low, words

public_tokenizers = pytest.importorskip("public_tokenizers")


# packing


def test_fill_is_best():
    for counts, room in itertools.product(({3: 2, 5: 1, 7: 3}, {4: 4}, {9: 1, 2: 1}, {}), range(0, 25)):
        best = max(sum(n * k for n, k in zip(counts, take, strict=True)) for take in itertools.product(*(range(c + 1) for c in counts.values())) if sum(n * k for n, k in zip(counts, take, strict=True)) <= room)
        got = packing.fill(counts, room)
        assert sum(n * k for n, k in got.items()) == best and all(got[n] <= counts[n] for n in got)


def test_packing_round_trip(edge, edge_rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(edge, path, window=256).collect()
    want = Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in edge_rows)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(itertools.accumulate([0, *(p.length for p in parts)]))[:-1]
        total = sum(p.length for p in parts)
        assert total == 256 or total & total - 1 == 0
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc, parts in by_doc.items():
        ids = Counter(i for p in parts for i in memoryview(p.ids).cast("I"))
        assert ids == Counter(i for (d, own), k in want.items() for i in own * k if d == doc)
        if sum(k for (d, _), k in want.items() if d == doc) == 1:
            parts.sort(key=lambda p: p.start)
            assert tuple(i for p in parts for i in memoryview(p.ids).cast("I")) == next(own for d, own in want if d == doc)
            assert [p.start for p in parts] == list(itertools.accumulate([0, *(p.length for p in parts)]))[:-1]
    assert packing.pack(none, path).count() == 0


def test_encoder_forgets(monkeypatch):
    import pyarrow as pa

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), most_words=2)
    text = "alpha beta. gamma, alpha 1.5. x'll É."
    for _ in range(3):
        ids, lengths = encoder.encode(pa.array(text.split()))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and lengths.sum() == len(ids)


# windows


@pytest.mark.parametrize("batch", [20, 1024])
def test_windows(edge, edge_rows, batch):
    got = Counter(tuple(r) for r in substrings.remove_repeats(edge, 13, batch=batch).collect())
    assert got == brute_repeats(edge_rows, 13)


def test_windows_of_sparse_ids_and_long_texts(spark):
    """Batches have about as many rows however ids are spread; a repeated id is whole; long texts make small batches."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(70))
    ids = [rng.randrange(1 << 60) for _ in range(150)] + [5] * 30
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) + (" " + passage if k % 3 else "") + " x y z" * (k % 7) * 20) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in substrings.batched(df, 16).groupBy("batch").count().collect()]
    assert max(sizes) <= 50 and len(sizes) >= 8 and substrings.batch_rows(1000, 10**9) == 4
    for batch in (16, 1024):
        assert Counter(tuple(r) for r in substrings.remove_repeats(df, 13, batch).collect()) == brute_repeats(rows, 13)
        found = suffixes.remove_passages(df, batch=batch).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, " ".join(words(r.text))) for r in found) == brute_repeats(rows, 50)


def test_windows_incrementally(spark, edge, edge_rows):
    """A later call with the compacted runs of an earlier one finds what one call over all finds."""
    known = [r for r in edge_rows if r[0] is not None]
    early, late = (spark.createDataFrame([r for r in known if (r[0] < 70) == first], edge.schema) for first in (True, False))
    runs = substrings.runs_of(substrings.batched(early, 20), 13, 2)
    history = substrings.compact(substrings.compact(runs, 2).union(runs), 2)
    got = Counter(tuple(r) for r in substrings.remove_repeats(late, 13, 20, history, 2).collect())
    want = brute_repeats(known, 13)
    assert got == Counter({k: n for k, n in want.items() if k[0] >= 70})


def test_windows_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0 and suffixes.remove_passages(none, carry=["lang"]).count() == 0


@pytest.mark.parametrize("batch", [20, 1024])
def test_passages(edge, edge_rows, batch):
    found = suffixes.remove_passages(edge, batch=batch, carry=["lang", "batch", "carry"]).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join(words(r.text))) for r in found)
    assert got == brute_repeats(edge_rows, 50)
    assert any(r.n_removed == 60 for r in found)
    for r in found:
        assert sum(s.stop - s.first for s in r.spans) == r.n_removed and r.carry is not None


# rules


def test_rules(edge, edge_rows, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.ledger(edge).collect())
    want = []
    for doc, text, *_ in edge_rows:
        own, text = words(text), text or ""
        at = defaultdict(list)
        for i in range(len(own) - 2):
            at[tuple(own[i : i + 3])].append(i)
        covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((doc, len(own), sum(map(len, own)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)))
    assert got == Counter(want)
    assert rules.ledger(none).count() == 0


def test_policies_and_ablations(edge):
    rows = rules.ledger(edge).select("fail_bits").collect()
    kept = rules.apply_policy(rules.ledger(edge), "v1").where("kept").count()
    assert kept == sum(not r.fail_bits & rules.mask("v1") for r in rows)
    for r in rules.ablations(rules.ledger(edge), "v2").collect():
        bit = rules.BITS[r.rule]
        assert r.failed == sum(bool(x.fail_bits & bit) for x in rows) and r.removed_alone == sum(x.fail_bits == bit for x in rows)


# mixing


def test_mixing(edge, edge_rows, none):
    found = mixing.mix(edge).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r[0], len(words(r[1]))) for r in edge_rows)
    sizes = Counter()
    for r in found:
        sizes[r.source] += r["size"]
        assert 0 <= r.taken <= 2 * r["size"] and all(0 <= p.position <= 1 for p in r.passes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights, caps = dict(zip(order, itertools.cycle((3, 1, 2)))), {s: 2 * sizes[s] for s in sizes}
    total, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:  # filling up, source by source
        level = (total - sum(want.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > caps[s]]
        if not over:
            want |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            want[s] = caps[s]
            open_.remove(s)
    for s in sizes:
        rows = [r for r in found if r.source == s]
        assert rows[0].target == pytest.approx(want[s]) and rows[0].source_size == sizes[s]
        assert sum(r.taken for r in rows) == int(rows[0].target + 1e-9)
    assert sorted(map(str, mixing.mix(edge).collect())) == sorted(map(str, found))
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mixing_splits_a_repeated_id(spark, monkeypatch, doc_id):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    rows = [(doc_id, f"w{i} " * (i % 5), "a") for i in range(300)] + [(100 + i, f"w{i} v", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sized = docs.withColumn("bucket", F.when(F.col("source") == "a", "0").otherwise("1")).withColumn("tie", F.xxhash64("text")).withColumn("size", mixing.n_words(F.col("text")))
    parts = [r["count"] for r in mixing.split_hot(sized, mixing.bucket_sums(sized), 340).where("source = 'a'").groupBy("bucket").count().collect()]
    assert len(parts) > 30 and sum(parts) == 300
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter((d, s, len(t.split())) for d, t, s in rows)
    for s in ("a", None):
        own = [r for r in found if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target + 1e-9)
    reads = sorted((p.position, p["words"]) for r in found if r.source == "a" for p in r.passes)
    assert len({p for p, _ in reads}) == len(reads)  # no two documents start at one place
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, found))


def test_schedule(edge):
    rows = mixing.schedule(edge).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len(rows) and set(rows[0].__fields__) == {*edge.columns, "position"}
    taken = mixing.mix(edge).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r.text)) for r in rows) == taken


def test_query_goes_by_the_schedule(spark, edge, monkeypatch):
    """op4_mixing counts what the sorted readings have, of rows that repeat an id too."""
    monkeypatch.setattr(queries, "documents", lambda *_: edge)
    found = queries.op4_mixing(spark, "")
    assert "rangepartitioning(position" in found._jdf.queryExecution().executedPlan().toString()
    wanted = mixing.mix(edge).select("doc_id", "size", "source_size", "target", "taken", F.get("passes", F.lit(0))["position"].alias("position"))
    assert found.dtypes == wanted.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


# licenses


def test_licenses(edge, edge_rows, none):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(edge).collect())
    want = []
    for doc, text, *_ in edge_rows:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        want.append((doc, len(own), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == Counter(want)
    assert licenses.scan(none).count() == 0


def test_license_lines_are_complete(spark):
    """All lines that contain enough of a template are found, whatever the words' frequencies."""
    lines = [" ".join(t.split()[:k] + ["and"] * j) for _, t in licenses.TEMPLATES for k in range(1, len(t.split()) + 1) for j in (0, 3)]
    rows = spark.createDataFrame([(i, f"start\n{x}") for i, x in enumerate(lines)], "doc_id long, text string")
    got = {(r.doc_id, r.template) for r in licenses.template_matches(rows).collect()}
    want = {(i, k) for i, x in enumerate(lines) for k, (_, t) in enumerate(licenses.TEMPLATES) if len(set(x.split()) & set(t.split())) >= licenses.THRESHOLD * len(set(t.split())) - 1e-9}
    assert got == want and want


# near duplicates


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(edge, edge_rows, shingle):
    found = minhash.near_duplicates(edge, shingle).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(edge_rows, shingle, 80)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in found)


def test_chains_and_crowds(spark):
    """Chains of near copies whose ends differ are one component, and crowds of almost-near texts keep apart."""
    rows = []
    for k in range(12):  # each step changes one word of 40
        rows.append((k, " ".join(f"c{i}" if i >= k else f"d{i}" for i in range(40))))
    for k in range(30):  # a shared core of too small a share
        rows.append((100 + k, " ".join([f"k{i}" for i in range(55)] + [f"own{k}x{i}" for i in range(20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2, 3):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2, rounds=rounds).collect())
        assert got == brute_components(rows, 2, 80)


def test_links_beside_the_centre(spark):
    """Texts that are too far from a crowd's centre and linked with others of it, cut ones, and crowds within a crowd, with any number of rounds."""
    rng = random.Random(11)
    core = [f"k{i}" for i in range(90)]
    rows = [(1000, " ".join(core))]
    for k in range(160):
        own = list(core)
        for i in rng.sample(range(90), rng.randrange(1, 9)):
            own[i] = rng.choice((f"own{k}x{i}", f"common{i}", own[i - 1]))
        start = rng.choice((0, 0, 0, 6, 12))
        rows.append((k, " ".join(own[start : 90 - rng.choice((0, 0, 7))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2, 3):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2, rounds=rounds).collect())
        assert got == brute_components(rows, 2, 80)


def test_near_duplicates_of_all_documents(spark):
    """The registered query's recall and precision over whole tables, against all pairs."""
    for folder, shingle in (("sf0.001", 2), ("sf0.001", 5), ("sf0.01", 2)):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle).collect())
        assert got == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], shingle, 80)


def test_near_duplicates_of_nothing(none):
    assert minhash.near_duplicates(none).count() == 0


def test_estimate_is_close(spark):
    import numpy as np

    sets = [np.unique(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64))]
    sets.append(np.sort(np.concatenate([sets[0][:3600], np.random.default_rng(2).integers(0, 2**63, 400, dtype=np.uint64)])))
    table = minhash.registers([np.sort(minhash.mix(x)) for x in sets])
    df = spark.createDataFrame([(bytearray(table[0].tobytes()), bytearray(table[1].tobytes()))], "a binary, b binary")
    assert df.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(3600 / 4400, abs=0.1)


# fingerprints


def test_fingerprints(edge, edge_rows, none):
    found = fingerprints.fingerprints(edge).select("doc_id", "text", "edited", "root", "edited_root", fingerprints.likeness("", "edited_").alias("near"), fingerprints.differences("", "edited_").alias("differs"), "leaves", "edited_leaves").collect()
    assert len(found) == len(edge_rows)
    rows = sorted(((r[0], r[1] or "") for r in edge_rows if r[0] is not None and edge_rows.count(r) == 1 and sum(r[0] == x[0] for x in edge_rows) == 1), reverse=True)
    known = {r.doc_id: r for r in found if r.doc_id is not None}
    for (doc, text), (_, after) in itertools.pairwise(rows):
        if not any(x[0] is not None and rows[rows.index((doc, text)) + 1][0] < x[0] < doc for x in edge_rows):
            half = len(text) // 2
            assert known[doc].edited == text[: len(text) - half] + after[:half]
    roots = defaultdict(set)
    for r in found:
        roots[r.text].add(r.root)
        assert 0 <= r.near <= 1 and (r.root == r.edited_root) == (r.text == r.edited)
        missing = [i for i, x in enumerate(r.leaves) if x not in r.edited_leaves]
        assert set(missing) <= set(r.differs) and r.differs == sorted(set(r.differs)) and (r.root != r.edited_root or not r.differs)
    assert all(len(x) == 1 for x in roots.values()) and len({x for s in roots.values() for x in s}) == len(roots)
    assert fingerprints.fingerprints(none).count() == 0


def test_an_inserted_sentence_is_located(spark):
    """It changes its own branch only: the leaves before and after keep their paragraphs and sections."""
    rng = random.Random(8)
    sentences = [" ".join(f"w{rng.randrange(5000)}" for _ in range(9)).capitalize() + ". " for _ in range(600)]
    rows = [(k, "".join(sentences), "".join(sentences[:k] + ["Something new here. "] + sentences[k:])) for k in (0, 1, 299, 300, 599, 600)]
    rows.append((1000, "".join(sentences), "".join(sentences[:10] + [sentences[11], sentences[10]] + sentences[12:])))  # two change places
    df = spark.createDataFrame(rows, "k int, old string, new string")
    trees = fingerprints.tree(fingerprints.tree(df, "old", "o_"), "new", "n_")
    for r in trees.select("*", fingerprints.differences("n_", "o_").alias("added"), fingerprints.differences("o_", "n_").alias("lost")).collect():
        assert len(set(r.n_sections) - set(r.o_sections)) <= 2 and len(r.o_sections) > 4 and len(set(r.n_paragraphs) - set(r.o_paragraphs)) <= 2
        near = {r.k} if r.k < 1000 else {10, 11}
        assert near <= set(r.added) and all(abs(i - min(near)) < 60 for i in r.added + r.lost)  # in one or two paragraphs


@pytest.mark.parametrize("bucket", [1, 2, 4096])
def test_next_document(spark, bucket):
    """Dense, sparse and repeated ids, and none: the order is (doc_id, hash of the text) falling, and it wraps."""
    rng = random.Random(2)
    ids = [*range(40), *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(40)), *[7] * 60, *[None] * 20]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r.text: r.next_text for r in fingerprints.with_next(df, bucket).collect()} == want
    sizes = common.bucketed(df.withColumn("tie", F.xxhash64("text")), bucket).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= max(160 * (bucket > 160), 12 * bucket)


def test_next_document_wraps(spark):
    rows = spark.createDataFrame([(i * 5000, f"t{i}") for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(rows).collect()}
    assert got == {0: "t3", 5000: "t0", 10000: "t1", 15000: "t2"}


# languages


def plain_kneser_ney(texts):
    """log2 probabilities by Kneser-Ney of one language's texts, straight from the definition: a function of (context, character)."""
    import math

    order, discount = 4, 0.75
    grams = [Counter() for _ in range(order + 1)]
    for word in (w for t in texts for w in words(t.lower())):
        marked = "\x02" * 3 + word + "\x03"
        for i in range(len(marked) - 3):
            grams[4][marked[i : i + 4]] += 1
    for k in (3, 2, 1):  # continuation counts
        for gram in grams[k + 1]:
            grams[k][gram[1:]] += 1

    def p(context, char):
        k = len(context) + 1
        below = p(context[1:], char) if context else 1 / 10_000
        after = {g: n for g, n in grams[k].items() if g[:-1] == context}
        if not after:
            return below
        total = sum(after.values())
        return max(after.get(context + char, 0) - discount, 0) / total + discount * len(after) / total * below

    def entropy(text):
        out, n = 0.0, 0
        for word in words(text.lower()):
            marked = "\x02" * 3 + word + "\x03"
            for i in range(len(marked) - 3):
                out, n = out - math.log(p(marked[i : i + 3], marked[i + 3])), n + 1
        return out / max(1, n)

    return p, entropy


def test_kneser_ney_by_definition(spark):
    """All three ways to score (arrays, tables with hot grams, tables alone) equal the plain-Python model, whose probabilities sum to one."""
    texts = {"aa": ["banana bandana cabana", "nab a Cab.", "a a a"], "bb": ["straße über alles", "äß \U0001d11e\U0001d11e über", "banane"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])]
    asked = [(100, "bandana über"), (101, "zzz"), (102, "\U0001d11ea Straße cabana nab"), (103, "banana")]
    models = {lang: plain_kneser_ney(texts[lang]) for lang in texts}
    for p, _ in models.values():
        for context in ("\x02\x02\x02", "ban", "zzz"):
            assert sum(p(context, chr(c)) for c in [*range(1, 600), 0x1D11E]) + (10_000 - 600) * p(context, "\uffff") == pytest.approx(1, abs=0.03)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    for memory, hot in ((10**6, 0), (0, 5), (0, 10**6)):
        for r in language.predict(queries, language.fit(docs, 0, memory, hot)).collect():
            want = {lang: entropy(dict(asked)[r.doc_id]) for lang, (_, entropy) in models.items()}
            assert r.entropy == pytest.approx(min(want.values()), abs=1e-9) and r.lang == min(want, key=want.get)


def test_language_edges(spark, edge, none):
    model = language.fit(edge)
    found = language.predict(edge, model).collect()
    assert model.langs == ["de", "en"] and len(found) == edge.count()
    texts = edge.select("doc_id", "text").collect()
    blank = {r.doc_id for r in texts if r.doc_id is not None and not any(c.isalpha() for c in r.text or "")}
    assert all((r.lang == "und") == (r.doc_id in blank) for r in found if r.doc_id not in (None, 7)) and all(0 <= r.score <= 1 for r in found)
    nothing = language.fit(none)
    assert nothing.langs == [] and {r.lang for r in language.predict(edge, nothing).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_language_tables_keep_every_gram(spark):
    """More grams than a task holds: each text's result is that of the whole tables in memory."""
    rng = random.Random(3)
    letters = {"aa": "abcdefghijklmnopqrst", "bb": "jklmnopqrstuvwxyzäß\U0001d11e"}
    rows = [(i, " ".join("".join(rng.choices(letters[x], k=6)) for _ in range(60)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, None, "aa"), (1001, "Zebra zzzz qqq \U0001d11e", None), (1001, "other words", None), (1002, "...", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    results = []
    for memory, hot in ((10**6, 0), (0, 100), (0, 2_000)):
        model = language.fit(docs, memory_rows=memory, hot_grams=hot)
        assert (model.memory is None) == (memory == 0) and model.grams[-1].count() > 20_000
        results.append(Counter((r.doc_id, r.lang, r.rejected, round(r.entropy, 9), round(r.score, 9)) for r in language.predict(docs, model).collect()))
    assert results[0].total() == len(rows) and results[0] == results[1] == results[2]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality.fold(F.col("doc_id")) == 0
    found = language.predict(docs.where(held), language.fit(docs.where(~held))).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r.lang == r.truth for r in found) / len(found) >= 0.98
    assert sum(r.rejected for r in found) / len(found) < 0.05


# quality


def test_fold(spark):
    rows = spark.range(50).select(F.col("id"), quality.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(0, 1), (7, 0), (None, 1), (14, None)], "doc_id long, quality int")
    model = quality.fit(edge, labels)
    assert {r.score for r in quality.score(edge, model).collect()} == {0.5}
    assert quality.score(none, model).count() == 0 and quality.fit(none, labels.limit(0)).good == b""


def test_quality_ranks_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels)
    held = labels.where(quality.fold(F.col("doc_id")) == 0)
    rows = quality.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model, carry=["lang"]).join(held, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.9
    assert sum(g >= quality.THRESHOLD for g in good) / len(good) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    empty = quality.score(docs.limit(1).withColumn("text", F.lit(None).cast("string")), model).first()
    assert 0 <= empty.score <= 1


def test_quality_is_the_size_difference(spark):
    """Scores from zstandard called directly, piece by piece, in plain Python; repeated ids and both labels of one id."""
    import math

    import zstandard

    rng = random.Random(4)
    good, bad = [f"g{i}x" for i in range(90)], [f"b{i}y" for i in range(90)]
    rows = [(i, " ".join(rng.choices((bad, good)[i % 2], k=80)) + rng.choice((".", "! So?\n\n", "")) + "z" * (i % 7) * 60) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(0, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, (4, "a repeat of an id"), (500, None), (501, ""), (None, "text " * 9000)], "doc_id long, text string")
    model = quality.fit(docs, labels)
    sides = []
    for raw in (model.good, model.bad):
        parameters = zstandard.ZstdCompressionParameters.from_level(3, source_size=256, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        sides.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), compression_params=parameters))
    want = Counter()
    for doc, text in [tuple(r) for r in docs.collect()]:
        pieces = re.findall(rb"[^.!?\n]{1,256}[.!?\n]*|[.!?\n]{1,256}", (text or "").encode())
        assert b"".join(pieces) == (text or "").encode()
        a, b = (sum(len(c.compress(x)) for x in pieces) for c in sides)
        want[doc, round(1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * 100 * (b - a) / max(1, a + b)))), 6)] += 1
    got = quality.score(docs, model).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want and model.weights[1] > 0
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in held)


def test_hash_of_words_is_stable():
    assert hashlib.sha256(" ".join(words("a\tb\x0bc  d")).encode()).hexdigest() == hashlib.sha256(b"a b c d").hexdigest()
