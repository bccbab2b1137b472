import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxtab.operators import profile as P


def candidates(df, **kw):
    return [(r.column, round(r.confidence, 6)) for r in
            P.text_column_candidates(df, "n", **kw).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, f"Item {i}", "It is fine, I use it", "I like this one very much, and would get it "
             f"again any time {i}", dt.datetime(2024, 1, 1 + i % 28), 5) for i in range(60)]
    return spark.createDataFrame(rows, "n long, title string, description string, review string, "
                                       "day timestamp, rating long")


def test_ranking_and_ties(reviews):
    assert candidates(reviews) == [("review", 1.0), ("description", 0.8), ("title", 0.2)]


def test_reasons_and_samples(reviews):
    best = P.text_column_candidates(reviews, "n").first()
    assert best.reason == ("Column name contains 'review'; Long average text length (61 chars); "
                           "Multi-word text (100%)")
    assert len(best.sample_values) == 3


def test_hint_wins_whatever_the_case(reviews):
    assert candidates(reviews, hint="TITLE")[0] == ("title", 1.0)
    assert candidates(reviews, hint="nothing") == candidates(reviews)


def test_hint_beats_emptiness(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y")], "n long, body string, c string")
    assert candidates(df) == []
    assert candidates(df, hint="body") == [("body", 1.0)]
    row = P.text_column_candidates(df, "n", hint="body").first()
    assert row.sample_values == [] and row.reason == "Exact match with user hint"


def test_whole_days_and_numbers_score_like_text(spark):
    rows = [(i, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 9, 30), 1234567.25 + i, 2.0e7)
            for i in range(10)]
    df = spark.createDataFrame(rows, "n long, day timestamp, at timestamp, v double, w double")
    got = {r["column"]: r for r in P.column_confidence(df, "n").collect()}
    assert got["day"].confidence == 0.0
    assert got["at"].confidence == pytest.approx(0.3)
    assert got["v"].mean_length == 10 and got["w"].mean_length == 10


def test_sparse_columns_are_read_past_the_head(spark):
    df = spark.range(5000).select(
        F.col("id").alias("n"), F.lit("x").alias("dense"),
        F.when(F.col("id") % 40 == 39, F.concat(F.lit("note "), "id")).alias("sparse"))
    heads = P.column_heads(df, "n")
    assert {r["column"]: r["count"] for r in heads.groupBy("column").count().collect()} == {
        "n": 100, "dense": 100, "sparse": 100}
    first = heads.where("column = 'sparse'").orderBy("_order").first()
    assert first.value == "note 39"


def test_long_samples_are_cut(spark):
    df = spark.createDataFrame([(1, "a" * 200), (2, "b" * 100)], "n long, comment string")
    shown = P.text_column_candidates(df, "n").first().sample_values
    assert shown == ["a" * 97 + "...", "b" * 100]


@pytest.fixture(scope="module")
def unsure(spark):
    df = spark.createDataFrame([(1, "short"), (2, "text")], "n long, feedback string")
    return P.text_column_candidates(df, "n")


@pytest.mark.parametrize("answer, method, reason", [
    ('{"column": "feedback", "reasoning": "it says so"}', "llm", "LLM: it says so"),
    ('```json\n{"column": "feedback"}\n```', "llm", "LLM: Selected by LLM"),
    ('{"column": "other", "reasoning": "x"}', "heuristic", "Column name contains 'feedback'"),
    ("not json {", "heuristic", "Column name contains 'feedback'"),
])
def test_arbitration(spark, unsure, answer, method, reason):
    row = P.arbitrate(unsure, spark.createDataFrame([(answer,)], "answer string")).first()
    assert (row.column_name, row.method, row.reasoning) == ("feedback", method, reason)
    assert row.confidence == (0.85 if method == "llm" else 0.5)


def test_confident_choice_is_not_arbitrated(spark, reviews):
    decision = spark.createDataFrame([('{"column": "title"}',)], "answer string")
    row = P.arbitrate(P.text_column_candidates(reviews, "n"), decision).first()
    assert (row.column_name, row.method) == ("review", "heuristic")


def test_nothing_to_find(spark):
    numbers = spark.createDataFrame([(1, 0.5)], "n long, v double")
    with pytest.raises(ValueError, match="No text columns found"):
        P.detect_text_column(numbers, "n")
    with pytest.raises(ValueError, match="no rows"):
        P.detect_text_column(numbers.limit(0), "n")
