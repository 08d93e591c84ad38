import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of documents with a column that clashes with the operators' own names."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS id", "1 AS key", "2 AS n", "3 AS digest")

    return make
