import pytest




@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) rows; more columns by keyword."""

    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)

    return make
