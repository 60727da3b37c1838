import pytest


@pytest.fixture(scope="session")
def table(spark):
    """docs(rows) with ids, texts and extra columns whose names clash with the operators' own."""

    def make(rows, name="doc_id"):
        kinds = f"{name} bigint, text string, id string, n string, key string, rank string, part string"
        return spark.createDataFrame([(i, t, "x", "y", "z", "r", "p") for i, t in rows], kinds)

    return make
