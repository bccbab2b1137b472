"""Toxicity of texts: the highest score that a recurrent network gives to a window of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import chunks_of, documents, out_batch, read_table, schema_with
from voxtab.llm.gru import Gru
from voxtab.llm.language import held_out
from voxtab.operators.skew import top_k

#: Labelled texts of each label from which the network learns, at most, and their size.
SAMPLE_DOCS = 600
SAMPLE_BYTES = 1 << 15


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> Gru:
    """A network trained on the driver from a bounded sample.

    labels: ids and 0 or 1; other labels and NULLs teach nothing. Up to ``sample``
    rows a label, those whose ids hash lowest, are joined to texts of at most
    ``SAMPLE_BYTES``. The sample weighs both labels alike, so the scores are then
    shifted to the share of 1 among all labelled rows. With one label only, every
    score is near that label.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    some = top_k(rows.withColumn("key", F.xxhash64("id", F.lit(11))), 2 * sample, [F.col("key"), F.col("id")], ["y"])
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    found = top_k(texts.join(F.broadcast(some.select("id", "y", "key")), "id"), sample,
                  [F.col("key"), F.col("id"), F.col("text")], ["y"]).select("y", "key", "text").collect()
    found = sorted(found, key=lambda r: (r.key, r.text))
    model = Gru()
    model.train([r.text.encode() for r in found], np.array([r.y for r in found], np.int64))
    share = rows.agg(F.avg("y")).first()[0]
    if share and share < 1:
        model.p["bo"] = model.p["bo"] + np.float32(np.log(share / (1 - share)))
    return model


def score_texts(df: DataFrame, model: Gru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` and ``predicted`` of every row, from the windows of its whole text.

    NULL, empty and wordless texts score 0. Ids may be NULL or repeated; an empty
    table gives an empty one.
    """
    cols = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks_of(batches, "text"):
            score = model.scores(texts)
            yield out_batch(batch, ["id"], score=score, predicted=(score >= 0.5).astype(np.int32))

    return cols.mapInArrow(run, schema_with(cols, ["id"], "score double, predicted int"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), read_table(spark, folder, "labels")
    model = learn(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score_texts(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", "predicted")
