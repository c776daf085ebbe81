import pytest
from pyspark.sql import types as T


@pytest.fixture
def frame(spark):
    """A table of documents with columns of clashing names."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string, shard string"):
        fields = T.StructType.fromDDL(schema)
        return spark.createDataFrame([tuple(r) + (None,) * (len(fields) - len(r)) for r in rows], fields)

    return make
