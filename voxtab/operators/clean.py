"""Cleaning, spam removal, keep-first dedup, ledger and verdict (all optionally per group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.constants import MIN_ROWS, REMOVAL_REASONS
from voxtab.functions import text as X
from voxtab.functions.values import compute_once, fixed
from voxtab.operators.skew import first_per_key, group_join
from voxtab.sources.catalog import written

#: Ids of repeated texts that are sent to every task; no result depends on it.
FEW_IDS = 1 << 20


def with_clean_text(df: DataFrame, text_col: str, out: str = "clean_text",
                    where: Column | str | None = None) -> DataFrame:
    """Adds the cleaned text. ``where`` filters on stored columns before the cleaning."""
    df = df if where is None else df.where(where)
    return df.withColumn(out, compute_once(X.clean_text(F.col(text_col).cast("string"))))


def _judged(df: DataFrame, text_col: str) -> DataFrame:
    cleaned = with_clean_text(df, text_col)
    return cleaned.withColumn("_reason", X.removal_reason(F.col(text_col), F.col("clean_text")))


def _repeats(judged: DataFrame, id_col: str, group_cols: Sequence[str]) -> DataFrame:
    """``_repeat``: ids of usable rows whose text an earlier row of the group has.

    Digests and ids alone are shuffled: the smallest id of each digest is a plain
    hash aggregate, and only digests that stand more than once are joined back.
    """
    keyed = judged.where(F.col("_reason").isNull()).select(
        F.col(id_col).alias("_repeat"), *group_cols, X.text_key(F.col("clean_text")).alias("_key"))
    firsts = keyed.groupBy(*group_cols, "_key").agg(
        F.min("_repeat").alias("_first"), F.count("*").alias("_n"))
    more = firsts.where(F.col("_n") > 1)
    met = group_join(keyed, more, [*group_cols, "_key"], "inner")
    return met.where(F.col("_repeat") != F.col("_first")).select("_repeat")


def _marked(df: DataFrame, text_col: str, id_col: str, group_cols: Sequence[str],
            raw: bool = True) -> DataFrame:
    """Rows with ``clean_text`` and ``removal_reason``; each text is cleaned once and written down.

    The raw text is written only if asked for. Ids of repeats are broadcast up to
    ``FEW_IDS`` of them, so that texts stay where they are; more of them are shuffled.
    """
    if df.where(F.col(id_col).isNull()).limit(1).count():
        raise ValueError(f"Column '{id_col}' holds NULL ids")
    judged = _judged(df, text_col)
    judged = written(judged if raw else judged.drop(text_col))
    repeats = written(_repeats(judged, id_col, group_cols))
    few = repeats.count() <= FEW_IDS
    repeats = repeats.withColumn("_again", F.lit(True)).hint("broadcast" if few else "shuffle_hash")
    marked = judged.join(repeats, F.col(id_col) == F.col("_repeat"), "left")
    reason = F.coalesce("_reason", F.when(F.col("_again"), "duplicate"))
    return marked.withColumn("removal_reason", reason).drop("_reason", "_repeat", "_again")


def classify(df: DataFrame, text_col: str, id_col: str,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Every input row with ``clean_text`` and ``removal_reason`` (NULL = kept).

    Repeats are found on digests and marked through the unique id, so equal texts,
    however many, never meet in one task. NULL ids are an error.
    """
    return _marked(df, text_col, id_col, group_cols)


def clean(df: DataFrame, text_col: str, id_col: str,
          group_cols: Sequence[str] = ()) -> DataFrame:
    """Kept rows only, text replaced by clean text; texts are never sorted."""
    kept = _marked(df, text_col, id_col, group_cols, raw=False).where(F.col("removal_reason").isNull())
    return kept.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(c)
                         for c in df.columns])


def drop_unusable(df: DataFrame, text_col: str) -> DataFrame:
    """The stateless part of cleaning: every removal except duplicates."""
    judged = _judged(df, text_col).where(F.col("_reason").isNull())
    return judged.withColumn(text_col, F.col("clean_text")).drop("clean_text", "_reason")


def _per_text(df: DataFrame, text_col: str, group_cols: Sequence[str]) -> DataFrame:
    """One row per (reason or distinct kept text) with its count and length."""
    judged = _judged(df, text_col)
    key = F.when(F.col("_reason").isNull(), X.text_key(F.col("clean_text")))
    return judged.groupBy(*group_cols, "_reason", key.alias("_key")).agg(
        F.count("*").alias("_n"), F.max(F.length("clean_text")).alias("_len"))


def data_stats(df: DataFrame, text_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts per removal reason and length statistics of the kept texts: one scan."""
    kept = F.col("_reason").isNull()
    length = F.when(kept, F.col("_len"))

    def count(condition: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")

    n, one = F.col("_n"), F.lit(1).cast("long")
    per_reason = [count(F.col("_reason") == r, n).alias(r) for r in REMOVAL_REASONS[:-1]]
    stats = _per_text(df, text_col, group_cols).groupBy(*group_cols).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"),
        count(kept, one).alias("rows_after_cleaning"),
        *per_reason,
        count(kept, n - 1).alias("duplicate"),
        F.avg(length).alias("avg_text_length"),
        F.min(length).cast("long").alias("min_text_length"),
        F.max(length).cast("long").alias("max_text_length"),
    )
    return stats.withColumn("removed_rows", F.col("total_rows") - F.col("rows_after_cleaning"))


def removal_ledger(df: DataFrame, text_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long form of the removal counts: reason (or 'keep'), cnt."""
    stats = data_stats(df, text_col, group_cols)
    pairs = F.array(
        *[F.struct(F.lit(r).alias("reason"), F.col(r).alias("cnt")) for r in REMOVAL_REASONS],
        F.struct(F.lit("keep").alias("reason"), F.col("rows_after_cleaning").alias("cnt")),
    )
    return stats.select(*group_cols, F.inline(pairs))


def validation_verdict(stats: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds status and warnings; the warnings do not change the status."""
    total, removed = F.col("total_rows"), F.col("removed_rows")
    status = (
        F.when(F.col("rows_after_cleaning") < min_rows, "fail")
        .when(removed > total * 0.5, "warning")
        .otherwise("pass")
    )
    many = F.when(removed > total * 0.3,
                  F.format_string("Removed %d rows (>30%% of data)", removed))
    short = F.when(
        F.col("avg_text_length") < 10,
        F.format_string("Average text length is very short (%s chars)",
                        fixed(F.col("avg_text_length"), 1)),
    )
    return stats.withColumn("status", status).withColumn(
        "warnings", F.filter(F.array(many, short), lambda w: w.isNotNull()))


def language_guess(df: DataFrame, text_col: str, id_col: str, sample: int = 20,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """'en' if more than half of the first texts hold a common English word."""
    has = X.has_english_word(F.col(text_col).cast("string"))
    flags = df.select(*group_cols, id_col, F.coalesce(has, F.lit(False)).alias("_has"))
    if group_cols:
        heads = first_per_key(flags, group_cols, [F.col(id_col)], sample, F.col("_has"), "_flags")
        heads = heads.select(*group_cols, F.explode("_flags").alias("_has"))
    else:
        heads = flags.orderBy(id_col).limit(sample)
    share = F.avg(F.col("_has").cast("double"))
    return heads.groupBy(*group_cols).agg(
        share.alias("english_share"),
        F.when(share > 0.5, "en").otherwise("unknown").alias("language"),
    )
