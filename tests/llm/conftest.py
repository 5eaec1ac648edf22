import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from rows of (doc_id, text) or (doc_id, text, lang, source), with columns that clash."""

    def made(rows, lang="en", source="s"):
        full = [(*r, lang, source)[:4] if len(r) < 4 else r for r in rows]
        frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCUMENTS)
        return frame.selectExpr("*", "'x' AS row_id", "'y' AS bucket", "'z' AS topic", "'w' AS weight", "'v' AS key")

    return made
