from __future__ import annotations

import pytest

from meterloom.llm.common import prepare


@pytest.fixture
def corpus(spark):
    return prepare(spark)


@pytest.fixture
def documents(corpus):
    """Rows of ``doc_id, text`` with the other columns of documents and a clashing one."""

    def make(rows):
        data = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, block int"
        return corpus.createDataFrame(data, schema)

    return make
