import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns whose names the operators use themselves
    T.StructField("doc", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("component", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows of (doc_id, text[, lang, source])) with clashing extra columns."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:] + (None, None))[:2], len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
