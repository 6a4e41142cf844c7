"""Small tables and a comparison by sorted rows."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from ``(doc_id, text)`` or whole rows."""

    def make(rows):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}
