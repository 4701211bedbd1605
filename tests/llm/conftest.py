import pytest


@pytest.fixture
def rows(spark):
    """rows(schema, [tuples]) -> DataFrame"""
    def make(schema, data):
        return spark.createDataFrame(data, schema)
    return make
