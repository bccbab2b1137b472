"""Cleaning of a document corpus for training: the stages, each a DataFrame of documents to the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm import bpe, decontaminate, language, secrets, simhash
from voxtab.llm.common import bound_batches, free_name, read_table, whole_row, written
from voxtab.sources.catalog import shared_folder

#: Likeness to the nearest language profile below which a text is in none of the languages.
LEAST_LIKENESS = 0.15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that are like no language; ``lang`` stays as it was.

    Profiles are learned from the labelled documents of the stage's input. Without
    any, every text with a letter stays.
    """
    bound_batches(spark)
    profiles = language.learn(docs)
    if not profiles.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, profiles, whole_row(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (
        F.col("likeness") >= LEAST_LIKENESS)).select("id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that with the smallest doc_id (NULL last), then the smallest digest.

    Rows are told apart by a digest of all their columns, so texts are shuffled
    once, to meet the digests that stay. Rows alike in every column are one.
    """
    bound_batches(spark)
    key, name = free_name(docs, "_key"), free_name(docs, "_name")
    keyed = docs.withColumn(key, F.sha2(F.to_json(whole_row(docs)).cast("binary"), 256))
    named = keyed.withColumn(name, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(key).alias("key")))
    kept = simhash.representatives(named, name).select(F.col("id.key").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    bound_batches(spark)
    found = decontaminate.occurrences(
        docs, read_table(spark, sf_dir, "benchmark"), whole_row(docs))
    return found.where(F.size("spans") == 0).select("id.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark and count characters anew where that changed a text."""
    before = free_name(docs, "_before")
    done = secrets.redacted(docs.withColumn(before, F.xxhash64("text")))
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.withColumn("n_chars", F.when(F.xxhash64("text") == F.col(before), F.col("n_chars"))
                           .otherwise(count)).drop(before)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs, bpe.default_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode_texts),
]

#: Profiles, fingerprints and merges have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
