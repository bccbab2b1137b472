"""Distributions and ranked summaries of scored comments, overall or per group.

Scored rows carry ``sentiment``, ``emotion``, ``topics``, ``entities`` and
``keyphrases``; the id is a whole number giving the reading order, so the first
comment to name a term wins ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtab.constants import (
    ENTITY_CONTEXTS,
    KEYPHRASES_USED,
    SAMPLE_LENGTH,
    TOP_ENTITIES,
    TOP_KEYPHRASES,
    TOP_TOPICS,
    TOPIC_SAMPLES,
    TOPICS_USED,
)
from voxtab.functions.scoring import sentiment_value
from voxtab.operators.skew import first_per_key, group_join, top_k



def _order_key(id_col: str, pos: Column, slots: int | None) -> Column:
    """One number for (id, position), so that first-seen order is a plain minimum.

    A decimal holds it for every id and keeps the counting in a hash aggregate,
    which a struct would not. ``slots`` bounds the position.
    """
    return F.col(id_col).cast("decimal(20,0)") * F.lit(slots or 1 << 31) + pos


def distribution(scored: DataFrame, label: Column | str, group_cols: Sequence[str] = (),
                 id_col: str | None = None) -> DataFrame:
    """label, cnt, pct of the group's total; with ``id_col`` also first_id, the tie order."""
    column = F.col(label) if isinstance(label, str) else label
    first = [F.min(id_col).alias("first_id")] if id_col else []
    counts = scored.groupBy(*group_cols, column.alias("label")).agg(
        F.count("*").alias("cnt"), *first)
    total = F.sum("cnt").over(Window.partitionBy(*group_cols))
    return counts.withColumn("pct", F.col("cnt") * 100.0 / total)


def sentiment_distribution(scored: DataFrame, group_cols: Sequence[str] = (),
                           id_col: str | None = None) -> DataFrame:
    return distribution(scored, "sentiment.label", group_cols, id_col)


def emotion_distribution(scored: DataFrame, group_cols: Sequence[str] = (),
                         id_col: str | None = None) -> DataFrame:
    return distribution(scored, "emotion.emotion", group_cols, id_col)


def _mentions(scored: DataFrame, terms: Column, fields: Sequence[str], text_col: str, id_col: str,
              group_cols: Sequence[str], slots: int | None) -> DataFrame:
    """One row per mention: the term's fields, comment sentiment, order key, text sample."""
    return scored.select(
        *group_cols,
        id_col,
        sentiment_value(F.col("sentiment.label")).alias("value"),
        F.substring(text_col, 1, SAMPLE_LENGTH).alias("sample"),
        F.posexplode(terms).alias("_pos", "_term"),
    ).select(
        *group_cols,
        *[(F.col("_term") if f == "*" else F.col(f"_term.{f}")).alias(n)
          for f, n in (x.split(" as ") for x in fields)],
        "value", "sample",
        _order_key(id_col, F.col("_pos"), slots).alias("order_key"),
    )


def _ranked(mentions: DataFrame, keys: Sequence[str], k: int,
            group_cols: Sequence[str]) -> DataFrame:
    counted = mentions.groupBy(*group_cols, *keys).agg(
        F.count("*").alias("cnt"), F.avg("value").alias("avg_sentiment"),
        F.min("order_key").alias("order_key"))
    return top_k(counted, k, [F.desc("cnt"), F.asc("order_key")], group_cols)


def _with_samples(ranked: DataFrame, mentions: DataFrame, keys: Sequence[str], n: int, out: str,
                  group_cols: Sequence[str]) -> DataFrame:
    """First n text samples of the winners only.

    Without groups there are at most k winners, so they are broadcast. With groups
    the planner chooses, and adaptive execution splits a key that is too hot.
    """
    on = [*group_cols, *keys]
    winners = ranked.withColumnRenamed("order_key", "_first")
    pool = group_join(mentions.drop("value"), winners if group_cols else F.broadcast(winners), on,
                      "inner")
    carry = [c for c in winners.columns if c not in on]
    return first_per_key(pool, on, [F.col("order_key")], n, F.col("sample"), out, carry)


def topic_summary(scored: DataFrame, text_col: str, id_col: str, k: int = TOP_TOPICS,
                  per_row: int = TOPICS_USED, samples: int = TOPIC_SAMPLES,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """rank, topic, cnt, avg_sentiment [, sample_comments] of the k most used topics."""
    mentions = _mentions(scored, F.slice("topics.topics", 1, per_row), ["* as topic"],
                         text_col, id_col, group_cols, per_row)
    ranked = _ranked(mentions, ["topic"], k, group_cols)
    if samples:
        ranked = _with_samples(ranked, mentions, ["topic"], samples, "sample_comments", group_cols)
    return ranked.drop("order_key", "_first")


def entity_summary(scored: DataFrame, text_col: str, id_col: str, k: int = TOP_ENTITIES,
                   contexts: int = ENTITY_CONTEXTS, group_cols: Sequence[str] = ()) -> DataFrame:
    """rank, text, type, cnt (mentions), sentiment [, contexts] of the k most named."""
    keys = ["text", "type"]
    mentions = _mentions(scored, F.col("entities"), ["text as text", "type as type"],
                         text_col, id_col, group_cols, None)
    ranked = _ranked(mentions, keys, k, group_cols)
    if contexts:
        ranked = _with_samples(ranked, mentions, keys, contexts, "contexts", group_cols)
    return ranked.drop("order_key", "_first").withColumnRenamed("avg_sentiment", "sentiment")


def top_keyphrases(scored: DataFrame, id_col: str, k: int = TOP_KEYPHRASES,
                   per_row: int = KEYPHRASES_USED, group_cols: Sequence[str] = ()) -> DataFrame:
    """rank, keyphrase, cnt of the k phrases most often among a comment's first ones."""
    phrases = scored.select(
        *group_cols, id_col,
        F.posexplode(F.slice("keyphrases.keyphrases", 1, per_row)).alias("_pos", "keyphrase"))
    return keyphrase_ranking(phrases, id_col, "_pos", k, per_row, group_cols)


def keyphrase_ranking(phrases: DataFrame, id_col: str, pos_col: str, k: int = TOP_KEYPHRASES,
                      slots: int = KEYPHRASES_USED,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """The same from a long table of phrases with their position (below ``slots``)."""
    order_key = F.min(_order_key(id_col, F.col(pos_col), slots)).alias("order_key")
    counted = phrases.groupBy(*group_cols, "keyphrase").agg(
        F.count("*").alias("cnt"), order_key)
    order = [F.desc("cnt"), F.asc("order_key")]
    return top_k(counted, k, order, group_cols).drop("order_key")


def mean_confidence(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """n, mean sentiment score, mean positive emotion confidence, and their average."""
    s = F.avg("sentiment.score")
    e = F.avg(F.when(F.col("emotion.confidence") > 0, F.col("emotion.confidence")))
    return scored.groupBy(*group_cols).agg(
        F.count("*").alias("n"), s.alias("sentiment_confidence"), e.alias("emotion_confidence"),
        F.coalesce((s + e) / 2, s).alias("confidence"))
