import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from a list of texts or (id, text); with a column whose name clashes with results."""

    def build(texts, extra=True):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], T._parse_datatype_string(DOCS))
        if extra:
            from pyspark.sql import functions as F

            for name in ("n_words", "kept", "score", "shard", "node", "id", "key", "removed", "bands", "spans"):
                df = df.withColumn(name, F.lit("clash"))
        return df.repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, unusual characters and a long text."""
    return [None, "", " \t\n ", "one", "one", (4, "one"), (None, "one"), (None, None), "tie tie tie tie tie tie", "ÄÖ ß 日本語 😀 \x85 　 x", "a\n\nb\n", "w" * 300_000, " ".join(f"w{i % 977}" for i in range(60_000)), "..."]
