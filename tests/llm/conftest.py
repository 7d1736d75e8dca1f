from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    if not os.path.exists(f"{DATA}/documents.parquet"):
        pytest.skip("driver test data not present")
    return DATA


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, ties, repeated rows, a very long text, null ids and
    sources, and extra columns whose names clash with the operators' own."""
    same = "the same words stand here and again they stand here"
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, same, "en", "a"), (4, same, None, "b"), (4, same, None, "b"),
            (5, "word " * 60_000, "en", "a"), (6, "für den Mann und die Frau mit dem Hut", "de", "b"), (None, same, "en", None),
            (None, None, None, None), (7, "x" * 100_000, "en", "b"), (8, " \n\t ", "en", "a"), (9, "12 34 !!", "de", "a")]
    return spark.createDataFrame([(*r, 1, "k", 7, True) for r in rows],
                                 "doc_id long, text string, lang string, source string, kept int, keep_id string, length int, held_out boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
