"""Passages in batches with fewer words than a passage has."""

from collections import Counter

import pytest
from brute import brute_repeats

from tidemark.llm import suffixes


@pytest.mark.parametrize("words", [0, 1, 15, 16, 17, 40, 43, 48, 49, 50, 51])
def test_few_words_in_a_batch(words):
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([3], pa.int64()), "text": [" ".join(f"w{i}" for i in range(words))], "batch": pa.array([0], pa.int64())})
    found = suffixes.Suffixes(table, 50, 16)
    assert len(found.at) == len(found.starts_with) == max(0, words - 49) and found.run(0, 2).num_rows == (words > 49)


def test_short_texts_in_batches_of_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(0, passage), (1000, " ".join(f"a{i}" for i in range(43))), (2000, "one two"), (3000, f"x {passage} y"), (4000, None)]
    found = suffixes.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"), batch=1).collect()
    kept = Counter((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in found)
    assert kept == brute_repeats(rows, 50)
