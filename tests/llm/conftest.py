import pytest

LONG = "alpha beta the gamma of delta " * 4000


def rows_with_edges(spark, sf, n=60):
    """Some documents and the odd cases: NULL, empty and long texts, repeated rows, NULL and equal ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n)
    some = [(r.doc_id, r.text) for r in docs.collect()]
    odd = [(90001, None), (90002, ""), (90003, LONG), (90004, " \t\n !!! "), (None, "no id the one here"),
           (90005, "twice the same text"), (90005, "twice the same text"), (90006, some[0][1]),
           (90007, "é中文😀 ß " * 30)]
    return some + odd


@pytest.fixture(scope="session")
def cases(spark, sf):
    return rows_with_edges(spark, sf)


@pytest.fixture(scope="session")
def docs(spark, cases):
    """The cases with further columns whose names operators use inside."""
    extra = [(i, t, 7, "x", 1.5, "en") for i, t in cases]
    return spark.createDataFrame(
        extra, "doc_id long, text string, _row int, id string, n double, lang string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
