import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """documents from (doc_id, text[, lang, source]) tuples."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
