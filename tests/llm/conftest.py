import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns that clash with the operators' own names."""
    def make(rows):
        full = [(i, t, "en", s, len(t or ""), 1.5, 7, "x", 1, 2, "h", 3, None) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, size long, slot string, id long, n int, h string, quality int, spans array<string>")

    return make
