import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text, source)."""

    def make(rows):
        full = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def folder(tmp_path):
    """A data folder from tables by name."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
