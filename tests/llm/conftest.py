import pytest


@pytest.fixture
def frame(spark):
    """Rows as a table of documents in several partitions, with a column that clashes."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint", parts=3):
        padded = [tuple(r) + (None,) * (schema.count(",") + 1 - len(r)) for r in rows]
        return spark.createDataFrame(padded, schema).repartition(parts)

    return make
