import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from brindle.llm.ship import ship

    return ship(spark)


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) pairs, or of texts."""

    def make(rows, lang="en", **extra):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t in pairs], SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make
