"""Finding the text column of a table from the first values of every column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import (
    ARBITRATION_BELOW,
    ARBITRATION_CONFIDENCE,
    LENGTH_STEPS,
    NAME_SCORE,
    SPACE_STEPS,
    TEXT_COLUMN_KEYWORDS,
)
from voxtab.functions.markdown import strip_fence
from voxtab.operators.skew import top_k
from voxtab.schemas import DECISION

SAMPLE = 100
WINDOW = 1000
SHOWN = 3


# Expressions over many columns are written as SQL text: one call each to the JVM
# instead of dozens.


def _name(field: T.StructField) -> str:
    return "`" + field.name.replace("`", "``") + "`"


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _is_double(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def printed(c: str, field: T.StructField) -> str:
    """A value as Python prints it, where Spark's own text form differs (SQL text)."""
    if _is_double(field):
        plain = (f"regexp_replace(cast(cast({c} AS decimal(38,22)) AS string), "
                 r"'(\\.\\d+?)0+$', '$1')")
        odd = (f"(abs({c}) >= 1e7 AND abs({c}) < 1e16) OR (abs({c}) >= 1e-4 AND abs({c}) < 1e-3)")
        return f"CASE WHEN {odd} THEN {plain} ELSE cast({c} AS string) END"
    if isinstance(field.dataType, T.BooleanType):
        return f"initcap(cast({c} AS string))"
    return f"cast({c} AS string)"


def _present(field: T.StructField) -> str:
    c = _name(field)
    return f"({c} IS NOT NULL AND NOT isnan({c}))" if _is_double(field) else f"({c} IS NOT NULL)"


def _from_head(head: DataFrame, order_col: str, fields: list[tuple[int, T.StructField]],
               sample: int) -> DataFrame:
    """First values of many columns from a head of a few hundred rows."""
    cells = ", ".join(
        f"struct({i} AS position, {_text(f.name)} AS column, "
        f"CASE WHEN {_present(f)} THEN {printed(_name(f), f)} END AS value)" for i, f in fields)
    long = head.select(F.col(f"`{order_col}`").alias("_order"), F.expr(f"inline(array({cells}))"))
    return top_k(long.where("value IS NOT NULL"), sample, [F.col("_order").asc_nulls_last()],
                 ["position", "column"]).select("position", "column", "_order", "value")


def _from_column(df: DataFrame, order_col: str, position: int, field: T.StructField,
                 sample: int) -> DataFrame:
    """First values of one column, read on its own and cut by a heap per partition."""
    return (
        df.where(_present(field))
        .select(F.col(f"`{order_col}`").alias("_order"), F.col(_name(field)).alias("_c"))
        .orderBy(F.col("_order").asc_nulls_last()).limit(sample)
        .select(F.lit(position).alias("position"), F.lit(field.name).alias("column"), "_order",
                F.expr(printed("_c", field)).alias("value"))
    )


def column_heads(df: DataFrame, order_col: str, sample: int = SAMPLE,
                 window: int = WINDOW) -> DataFrame:
    """position, column, _order, value: the first non-null values of every column, as text.

    The unique order column alone gives the end of a short head; the head is then
    read with a pushed-down range filter, which skips the rest of an ordered table.
    Only columns too sparse to fill their sample there are read in full, each on
    its own. Rows without an order key come last.
    """
    fields = list(enumerate(df.schema.fields))
    order = F.col(f"`{order_col}`")
    ids = df.select(order.alias("_order")).where(F.col("_order").isNotNull())
    end, rows = ids.orderBy("_order").limit(window).agg(F.max("_order"), F.count("*")).first()
    if not rows:
        return reduce(DataFrame.unionAll,
                      [_from_column(df, order_col, i, f, sample) for i, f in fields])
    if rows < window:
        return _from_head(df, order_col, fields, sample)
    head = df.where(order <= F.lit(end))
    counts = ", ".join(f"count_if({_present(f)})" for _, f in fields)
    filled = head.agg(F.expr(f"array({counts})")).first()[0]
    full = [x for x, n in zip(fields, filled) if n >= sample]
    parts = [_from_head(head, order_col, full, sample)] if full else []
    parts += [_from_column(df, order_col, i, f, sample)
              for (i, f), n in zip(fields, filled) if n < sample]
    return reduce(DataFrame.unionAll, parts)


def _steps(value: str, steps: list, which: int, otherwise: str) -> str:
    cases = " ".join(f"WHEN {value} > {step[0]} THEN {step[which]}" for step in steps)
    return f"CASE {cases} ELSE {otherwise} END"


def _reasons(value: str, shown: str, steps: list) -> str:
    texts = [(edge, score, f"format_string({_text(text)}, bround({shown}, 0))")
             for edge, score, text in steps]
    return _steps(value, texts, 2, "NULL")


def column_confidence(df: DataFrame, order_col: str, hint: str | None = None,
                      sample: int = SAMPLE) -> DataFrame:
    """One row per column that has values or is hinted: scores, confidence, reason, samples."""
    fields = df.schema.fields
    days = [_text(f.name) for f in fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    # A column of whole days prints without its times.
    whole_days = (f"column IN ({', '.join(days)}) AND min(endswith(value, ' 00:00:00'))"
                  if days else "false")
    stats = column_heads(df, order_col, sample).groupBy("position", "column").agg(
        F.expr(f"CASE WHEN {whole_days} THEN 10.0D ELSE avg(length(value)) END")
        .alias("mean_length"),
        F.expr(f"CASE WHEN {whole_days} THEN 0.0D "
               "ELSE avg(CASE WHEN contains(value, ' ') THEN 1.0D ELSE 0.0D END) END")
        .alias("space_share"),
        F.expr(f"slice(sort_array(collect_list(struct(_order, value))), 1, {SHOWN})")
        .alias("_shown"),
    )
    if hint is not None:
        hinted = [(i, f.name) for i, f in enumerate(fields) if f.name.lower() == hint.lower()]
        if hinted:
            named = df.sparkSession.createDataFrame(hinted, "position int, column string")
            stats = stats.join(F.broadcast(named), ["position", "column"], "full")

    # Names are metadata: their keywords are looked up here.
    found = [(f.name, next((k for k in TEXT_COLUMN_KEYWORDS if k in f.name.lower()), None))
             for f in fields]
    cases = " ".join(f"WHEN {_text(n)} THEN {_text(k)}" for n, k in found if k)
    stats = stats.withColumn("_keyword", F.expr(
        f"CASE column {cases} END" if cases else "cast(NULL AS string)"))
    stats = stats.select(
        "*",
        F.expr(f"CASE WHEN _keyword IS NULL THEN 0.0D ELSE {NAME_SCORE}D END").alias("name_score"),
        F.expr(f"cast({_steps('mean_length', LENGTH_STEPS, 1, '0')} AS double)")
        .alias("length_score"),
        F.expr(f"cast({_steps('space_share', SPACE_STEPS, 1, '0')} AS double)")
        .alias("space_score"),
        F.concat_ws(
            "; ",
            F.expr(
                "CASE WHEN _keyword IS NOT NULL THEN "
                "concat('Column name contains \\'', _keyword, '\\'') END"),
            F.expr(_reasons("mean_length", "mean_length", LENGTH_STEPS)),
            F.expr(_reasons("space_share", "space_share * 100", SPACE_STEPS)),
        ).alias("_reasons"),
    )
    is_hint = f"lower(column) = {_text((hint or '').lower())}" if hint is not None else "false"
    return stats.select(
        "position", "column", "mean_length", "space_share", "name_score", "length_score",
        "space_score",
        F.expr(f"CASE WHEN {is_hint} THEN 1.0D ELSE "
               "least(name_score + length_score + space_score, 1.0D) END").alias("confidence"),
        F.expr(f"CASE WHEN {is_hint} THEN 'Exact match with user hint' "
               "WHEN _reasons = '' THEN 'Low confidence' ELSE _reasons END").alias("reason"),
        F.expr("transform(coalesce(_shown, array()), s -> CASE WHEN length(s.value) > 100 "
               "THEN concat(substring(s.value, 1, 97), '...') ELSE s.value END)")
        .alias("sample_values"))


def text_column_candidates(df: DataFrame, order_col: str, hint: str | None = None,
                           sample: int = SAMPLE, k: int = 3) -> DataFrame:
    """The best k columns: rank, column, confidence, reason, sample_values.

    Ties go to the column further left. The result has as many rows as there are
    candidates, at most k.
    """
    scored = column_confidence(df, order_col, hint, sample).where(F.col("confidence") > 0)
    order = [F.desc("confidence"), F.asc("position")]
    best = scored.orderBy(*order).limit(k)
    packed = F.sort_array(F.collect_list(F.struct(
        (-F.col("confidence")).alias("_c"), "position", "column", "confidence", "reason",
        "sample_values")))
    return best.agg(packed.alias("_all")).select(F.posexplode("_all").alias("_i", "_s")).select(
        (F.col("_i") + 1).alias("rank"), "_s.column", "_s.confidence", "_s.reason",
        "_s.sample_values")


def arbitrate(candidates: DataFrame, decisions: DataFrame, answer_col: str = "answer",
              keys: Sequence[str] = ()) -> DataFrame:
    """The chosen column, after optional outside decisions given as a JSON table.

    Only asked for when the best confidence is below 0.7. An answer that does not
    parse or names no candidate changes nothing; of several that name one, the
    candidate of the best rank is taken. With ``keys``, which both tables have,
    there is a choice for every upload.
    """
    answer = F.from_json(strip_fence(F.col(answer_col)), DECISION, {"allowSingleQuotes": "false"})
    picks = decisions.select(*keys, answer.alias("_a")).where(F.col("_a.column").isNotNull()).groupBy(
        *keys, F.col("_a.column").alias("column")).agg(
        F.min(F.coalesce("_a.reasoning", F.lit("Selected by LLM"))).alias("_reasoning"))
    joined = candidates.join(picks, [*keys, "column"], "left")
    row = F.struct("column", "confidence", "reason", "sample_values")
    picked = F.struct("column", F.lit(ARBITRATION_CONFIDENCE).alias("confidence"),
                      F.concat(F.lit("LLM: "), "_reasoning").alias("reason"), "sample_values")
    both = joined.groupBy(*keys).agg(
        F.min_by(row, "rank").alias("_best"),
        F.min_by(picked, F.when(F.col("_reasoning").isNotNull(), F.col("rank"))).alias("_pick"))
    use = (F.col("_best.confidence") < ARBITRATION_BELOW) & F.col("_pick").isNotNull()
    chosen = F.when(use, F.col("_pick")).otherwise(F.col("_best"))
    return both.where(F.col("_best").isNotNull()).select(
        *keys, chosen["column"].alias("column_name"), chosen["confidence"].alias("confidence"),
        F.when(use, "llm").otherwise("heuristic").alias("method"),
        chosen["reason"].alias("reasoning"))


def detect_text_column(df: DataFrame, order_col: str, hint: str | None = None,
                       decisions: DataFrame | None = None) -> str:
    """Name of the text column; an error if the table is empty or no column qualifies."""
    if not df.columns or df.isEmpty():
        raise ValueError("Invalid DataFrame: no rows or no columns")
    candidates = text_column_candidates(df, order_col, hint)
    if decisions is None:
        found = candidates.where(F.col("rank") == 1).select("column").collect()
    else:
        found = arbitrate(candidates, decisions).select("column_name").collect()
    if not found:
        raise ValueError("No text columns found in DataFrame")
    return found[0][0]
