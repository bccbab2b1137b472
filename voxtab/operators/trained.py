"""Scorers that learn from labelled texts: hashed words, inverse document frequencies, logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.functions.values import argmax, let
from voxtab.schemas import SENTIMENT
from voxtab.sources.catalog import written

#: Words of a text are runs of letters and digits, in lower case.
GAPS = r"[^\p{L}\p{N}]+"
#: Slots that words are hashed into; the model holds one weight a slot and label.
SLOTS = 1 << 18
#: Slots met by fewer labelled texts carry no weight.
LEAST_TEXTS = 2
PENALTY = 0.01

_INNER = ["_words", "_counts", "_weighted", "rawPrediction", "probability", "prediction", "_plain"]


def fit_scorer(labelled: DataFrame, text_col: str, label_col: str, slots: int = SLOTS,
               penalty: float = PENALTY, max_iter: int = 60) -> PipelineModel:
    """A model of the labels 0, 1, ... given in ``label_col``; rows without text or label teach nothing.

    Every labelled row teaches, in passes over the rows that sum one gradient of fixed
    size per task. The labels count alike, however rare: each row weighs the inverse
    of its label's share. The labelled texts are written down once for these passes.
    """
    rows = written(labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(text_col).alias("_plain"), F.col(label_col).cast("double").alias("_label")))
    shares = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(shares) < 2:
        raise ValueError("A scorer needs rows of two labels at least")
    weight = F.lit(1.0)
    for label, n in shares.items():
        weight = F.when(F.col("_label") == label, sum(shares.values()) / (len(shares) * n)).otherwise(weight)
    stages = [
        RegexTokenizer(inputCol="_plain", outputCol="_words", pattern=GAPS),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=slots, binary=True),
        IDF(inputCol="_counts", outputCol="_weighted", minDocFreq=LEAST_TEXTS),
        LogisticRegression(featuresCol="_weighted", labelCol="_label", weightCol="_weight", regParam=penalty,
                           maxIter=max_iter, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_weight", weight))


def apply_model(df: DataFrame, model: PipelineModel, text_col: str, out: str) -> DataFrame:
    """Add ``out``, the probability of every label as an array. A NULL text is scored as empty; all columns stay."""
    clash = sorted(set(_INNER) & set(df.columns))
    if clash:
        raise ValueError(f"Columns used inside: {clash}")
    made = model.transform(df.withColumn("_plain", F.coalesce(text_col, F.lit(""))))
    return made.withColumn(out, vector_to_array("probability")).drop(*_INNER)


def sentiment_scorer(model: PipelineModel, labels: Sequence[str] = ("negative", "positive")
                     ) -> Callable[[DataFrame, str], DataFrame]:
    """A scorer with the sentiment contract out of a model of ``labels``: label, score, and scores of all three labels.

    The likeliest label wins, the first of equals. A model of two labels leaves
    neutral at 0. The result takes a frame and its text column and adds ``sentiment``.
    """
    def scorer(df: DataFrame, text_col: str) -> DataFrame:
        made = apply_model(df, model, text_col, "_p")
        p = F.col("_p")
        cells = [x for k, name in enumerate(labels) for x in (F.lit(name), p[k])]
        rest = [x for name in ("negative", "neutral", "positive") if name not in labels for x in (F.lit(name), F.lit(0.0))]
        best = let(argmax(list(labels), p), lambda label: F.struct(
            label.alias("label"), F.array_max(p).alias("score"), F.create_map(*cells, *rest).alias("scores")))
        return made.withColumn("sentiment", best.cast(SENTIMENT)).drop("_p")

    return scorer


def held_out_quality(scored: DataFrame, truth: str) -> DataFrame:
    """One row over scored rows with a known label: ``n``, ``accuracy`` and ``majority``, the share of the commonest label."""
    known = scored.where(F.col(truth).isNotNull())
    shares = known.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(F.col("sentiment.label") == F.col(truth)).alias("right"))
    return shares.agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"),
                      (F.max("n") / F.sum("n")).alias("majority"))
