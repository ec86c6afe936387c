"""Small tables with everything that can go wrong in a row."""

import pytest

from odd_rows import ODD_DOCS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeats, and columns named as the operators' own."""
    rows = [(*r, i, "x", i % 3, True) for i, r in enumerate(ODD_DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, size string, shard int, kept boolean").drop("row")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
