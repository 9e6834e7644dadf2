import pytest
from samples import EDGES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: further columns under names that the operators use themselves
CLASHING = ("k", "t", "row", "range", "score", "kept", "fingerprint", "fp", "tokens", "rate", "copies", "rejected", "host")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        """Documents from (doc_id, text[, lang]) rows."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        docs = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            from pyspark.sql import functions as F
            docs = docs.select("*", *(F.lit("x").alias(c) for c in CLASHING))
        return docs
    return make


@pytest.fixture(scope="session")
def edges(make_docs):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    return make_docs(EDGES, clashing=True)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([], clashing=True)
