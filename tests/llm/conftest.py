from __future__ import annotations


import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


LONG = "word " * 40_000
ODD_ROWS = [
    (1, "the same text on two rows", "en", "a", 1, "x"),
    (1, "the same text on two rows", "en", "a", 1, "x"),
    (2, None, "en", None, None, None),
    (3, "", None, "b", 0, "y"),
    (None, "no id here, but some words", "en", "b", 3, "z"),
    (None, None, None, None, None, None),
    (4, "  \n\t ", "en", "a", 4, "x"),
    (5, LONG, "en", "a", 5, "x"),
    (6, "Ünïcode ▁ <|endoftext|> \\### x </turn> \x85 é́", "de", "c", 6, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with NULLs everywhere, empty, very long and repeated texts, and columns named like the operators' own."""
    return spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumnsRenamed({"lang": "size"})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


