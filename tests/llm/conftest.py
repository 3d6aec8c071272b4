import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame of rows under a schema, spread over a few partitions."""

    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build
