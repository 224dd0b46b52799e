import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names clash with internal ones."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src1")), len(r[1]) if r[1] is not None else None, "x", "y", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, k string, bucket string, h long")

    return make
