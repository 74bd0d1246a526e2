import pytest

from alertweave.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def docs(corpus):
    """Make a documents table from (doc_id, text) pairs, with columns that clash."""

    def make(rows, clash=()):
        full = [(i, t, "en", "s", None if t is None else len(t), *(["x"] * len(clash))) for i, t in rows]
        schema = DOCS + "".join(f", {c} string" for c in clash)
        return corpus.createDataFrame(full, schema)

    return make
