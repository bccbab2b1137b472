import pytest
from pyspark.sql import functions as F

from voxtab.operators import trained as T


def test_learns_more_than_the_commonest_label(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (1 - F.col("toxic")).alias("good"))
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    model = T.fit_scorer(rows.where("doc_id % 5 <> 0"), "text", "good")
    out = T.sentiment_scorer(model)(rows.where("doc_id % 5 = 0"), "text").withColumn(
        "truth", F.when(F.col("good") == 1, "positive").otherwise("negative"))
    r = T.held_out_quality(out, "truth").first()
    assert r.n > 500 and r.accuracy > r.majority + 0.03
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_contract_and_odd_rows(spark):
    rows = [(k, f"good fine {k % 3}" if k % 2 else f"bad poor {k % 3}", k % 2) for k in range(40)]
    df = spark.createDataFrame([*rows, (90, None, 1), (91, "", 0), (92, "bad", None)], "id long, text string, y int")
    scorer = T.sentiment_scorer(T.fit_scorer(df, "text", "y", slots=64))
    out = {r.id: r.sentiment for r in scorer(df, "text").collect()}
    assert len(out) == 43 and scorer(df, "text").columns == ["id", "text", "y", "sentiment"]
    assert out[1].label == "positive" and out[0].label == "negative" == out[92].label
    assert all(abs(sum(s.scores.values()) - 1) < 1e-9 and s.scores["neutral"] == 0 for s in out.values())
    assert out[90] == out[91]
    three = T.sentiment_scorer(T.fit_scorer(df.withColumn("y", F.col("id") % 3), "text", "y", slots=64), [
        "negative", "neutral", "positive"])
    assert set(three(df, "text").first().sentiment.scores) == {"negative", "neutral", "positive"}
    assert scorer(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError, match="two labels"):
        T.fit_scorer(df.where("y = 1"), "text", "y")
    with pytest.raises(ValueError, match="Columns used inside"):
        scorer(df.withColumn("probability", F.lit(1)), "text")
