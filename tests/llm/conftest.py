import pytest

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n\n", "one", "x" * 5000, "long " * 4000, "a b c\n" * 40, "tie\ntie\ntie\ntie", "é   ſ İ 日本語 🎉🎉", "\t\x0b\x0c\r|#*"]


@pytest.fixture(scope="session")
def docs(spark):
    """All of sf0.001 and odd rows: null, empty and very long texts, ties, a repeated row, a null id, clashing extra columns."""
    known = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = known + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_007, ODD[7]), (None, "a null id has a text of its own")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, row_key int").repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
