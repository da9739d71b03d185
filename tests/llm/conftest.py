import pytest
from pyspark.sql import functions as F

from labelloom.llm.common import prepared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    """The session with this package's settings."""
    return prepared(spark)


@pytest.fixture
def documents(llm):
    """Build a documents table from (doc_id, text[, lang, source]) rows, with clashing extra columns."""
    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 len(r[1] or "")) for r in rows]
        return llm.createDataFrame(full, DOCS).withColumns({
            c: F.lit("extra") for c in ("size", "score", "key", "digest", "copies", "row", "words", "rep")})
    return build
