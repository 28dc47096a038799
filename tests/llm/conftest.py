import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, extra string"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, first=0):
        rows = [(i + first if not isinstance(t, Row) else t[0], t if not isinstance(t, Row) else t[1], "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
