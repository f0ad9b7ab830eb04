import pytest
from pyspark.sql import functions as F


@pytest.fixture
def rows(spark):
    """Makes a DataFrame with extra columns whose names operators use inside."""

    def make(data, schema, extra=("rec", "key", "text", "rep", "n", "version", "word", "source_text", "language_code")):
        df = spark.createDataFrame(data, schema)
        for c in extra:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
