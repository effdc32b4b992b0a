import pytest

from shopstar.llm.common import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def docs(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, __text string"


def doc_rows(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 9.0, "x", "y") for i, t, lang, s in rows], DOC_SCHEMA)


LONG = "word " * 200_000
# nulls in every column, empty and blank texts, a very long text, repeated rows and ids
ODD = [(1, None, None, None), (None, "a text without id", "en", "s1"), (2, "", "en", None), (3, " \t\n ", None, "s1"),
       (4, LONG, "en", "s1"), (5, "twin text here", "en", "s2"), (5, "twin text here", "en", "s2"), (5, "same id other text", "de", "s3"),
       (6, "Ünïcödé ẞ 漢字 ½ ²", "fr", "")]
