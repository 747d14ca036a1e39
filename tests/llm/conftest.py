import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text) rows, over a few partitions, with columns whose names clash with results."""

    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        frame = spark.createDataFrame(full, DOCS).repartition(parts)
        return frame.selectExpr("*", "1 AS score", "'x' AS kept", "2L AS n_words", "3L AS start")

    return make
