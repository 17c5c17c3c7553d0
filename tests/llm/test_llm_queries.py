"""The registered queries against their SQL, and the pipeline against its parts in plain Python."""

from collections import Counter, defaultdict

import pytest
from compare import DATA, assert_same
from brute import brute_components, brute_repeats, words

from tidemark.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, duck, name):
    df = llm.queries()[name](spark, DATA)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        n = spark.read.parquet(f"{DATA}/documents.parquet").count()
        assert df.select("doc_id").distinct().count() == n


def test_stages_by_brute_force(spark, tmp_path):
    """Every stage's result from its own input."""
    import corpus_pipeline as pipeline

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    start, good, unique, clean, mixed, packed = ([tuple(r) for r in df.collect()] for df in seen)
    assert all(df.columns == seen[0].columns for df in seen[1:-1])
    assert set(good) <= set(start) and len(good) >= 0.7 * len(start)
    kept = {d for d, _, low in brute_components(good, 5, 80) if d == low}
    assert Counter(unique) == Counter(r for r in good if r[0] in kept)
    want = {d: text for d, n, gone, text in brute_repeats(unique, 50) if gone < n or not n}
    assert {r[0]: " ".join(words(r[1])) for r in clean} == want
    sizes = Counter()
    for r in clean:
        sizes[r[3]] += len(words(r[1]))
    got = Counter()
    for r in mixed:
        got[r[3]] += len(words(r[1]))
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) <= len(sizes) and all(got[s] <= 2 * sizes[s] for s in got)
    assert {r[0] for r in mixed} <= set(want)
    by_sequence = defaultdict(int)
    for r in packed:
        by_sequence[r[5]] += r[2]
    assert Counter(r[0] for r in packed if r[1] == 0) == Counter(r[0] for r in mixed)
    assert all(n == 2048 or n & n - 1 == 0 for n in by_sequence.values())


def test_run_is_the_stages(spark):
    import corpus_pipeline as pipeline

    rows = pipeline.run(spark, DATA)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0
