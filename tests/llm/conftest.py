from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) with an extra column whose name clashes with results."""

    def build(rows, lang="en", source="a"):
        full = [(i, t, lang, source, len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, COLUMNS + ", size string")

    return build
