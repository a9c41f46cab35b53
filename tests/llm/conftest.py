import pytest

from quillspark.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function: rows (id, text[, lang[, source]]) as documents, with extra columns of names that operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "x", 1, None, 2.5) for r in rows]
        return spark.createDataFrame(full, DOCS + ", size string, slot int, kept boolean, score double")

    common.prepare(spark)
    return make


def got(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}
