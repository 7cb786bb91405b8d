import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A table with a clashing extra column from (doc_id, text) rows."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 4 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
        return df.withColumns({c: F.lit(1) for c in ("norm", "digest", "id", "size", "n", "score", "best", "n_bytes")})

    return make
