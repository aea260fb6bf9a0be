import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text[, source]) as a table with columns whose names clash with those that operators add."""

    def make(rows, schema="doc_id long, text string"):
        import pyspark.sql.functions as F

        df = spark.createDataFrame(rows, schema)
        for c in ("d", "t", "key", "score", "n", "x", "id", "size", "rank", "kept"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df

    return make


def words(n, seed, vocabulary=4000):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
