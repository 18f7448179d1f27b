import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, 7, "x", True, 1.5) for r in rows]
        return spark.createDataFrame(full, DOCS + ", size long, spans string, kept boolean, score double")

    return make
