import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, spans int, key double"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names operators use themselves: ``docs((id, text, lang), ...)``."""
    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "x", 1, 0.5) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
