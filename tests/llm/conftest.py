from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, words int, bucket string, size double, cid string, carry int, next string"


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls, empty, blank, one-word and very long texts, exact and near copies, shared passages, repeated rows and ids, clashing columns."""
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 60, 5000)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \t\n ", "one", "One", "two words", base, base, base.upper(), " ".join(near), "\n".join([base] * 3), sentence(rng, 9000),
        sentence(rng, 40) + " " + passage + " " + sentence(rng, 40), sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 20), passage, "Äé ß %%% ## a<b>", "x " * 80, "<|endoftext|> it's. 'S",
        "Licensed under the Apache License, Version 2.0.\nMIT license. mit-license", "All rights reserved.\n" + sentence(rng, 60), "cc by cc by",
    ]
    rows = [(7 * i, t, ("en", "de", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t or ""), "x", 1, "y", 0.5, "z", 2, "n") for i, t in enumerate(texts)]
    rows += [rows[6], (7, "same id, other text " + base, "en", "a", 1, None, None, None, None, None, None, None), (None, base, "en", "a", 1, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
