import pytest

pytest.importorskip("lectern.llm")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs with extra columns of clashing names."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 1, "x", 2) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", score double, predicted int, key string, n int")

    return make
