from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, key string, fp string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, lang]) rows, with further columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1]), "x", None, "k", "f") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
