import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None, source="s"):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return make
