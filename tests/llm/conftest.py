from __future__ import annotations

import pytest

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
ODD = [
    (0, None, None, None),
    (1, "", "en", "s"),
    (2, A, "en", "s"),
    (2, A, "en", "s"),
    (3, A, None, None),
    (None, "a text without an id, but with a few words in it", "en", "s"),
    (5, "... 123 !!", "en", "s"),
    (6, LONG, "en", "s"),
    (7, "  two  blanks \n\n and é漢😀 ▁ lines\n", "fr", "s"),
    (8, "x", "fr", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, long and repeated rows, and columns named like results."""
    clash = ", size string, shard string, slot string, score string, lang_pred string, ids string, key string, class_id string, clean_text string, n_dropped string, fp string"
    return spark.createDataFrame([(*r, *["own"] * 11) for r in ODD], "doc_id long, text string, lang string, source string" + clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
