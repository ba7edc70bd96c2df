import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Texts (or (id, text) pairs) to a documents frame, over several partitions, with a column that clashes with what operators add."""

    def make(texts, clash=None):
        pairs = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS).repartition(3)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("clash") for c in clash})
        return df

    return make
