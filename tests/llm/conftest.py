import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, source)."""

    def make(rows):
        rows = [(k, r, "s") if r is None or isinstance(r, str) else r for k, r in enumerate(rows)]
        return spark.createDataFrame([(k, t, "x", s, len(t or "")) for k, t, s in rows], DOCS)

    return make
