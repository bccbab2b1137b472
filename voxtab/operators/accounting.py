"""Tokens, costs, call metrics, job state and data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import (
    DEFAULT_PRICE,
    EMOTIONS,
    PRICES,
    SECONDS_PER_COMMENT,
    SENTIMENTS,
    TOPICS_PER_COMMENT,
)
from voxtab.functions.values import py_round
from voxtab.operators.skew import group_join
from voxtab.sources.catalog import written

RULE_NAMES = ["sentiment_label", "sentiment_score", "emotion_label", "emotion_confidence",
              "topics_count", "entity_confidence"]
PRICE_SCHEMA = "model string, price_in double, price_out double"


def price_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(PRICES, PRICE_SCHEMA)


def token_cost(df: DataFrame, tokens_in: str, tokens_out: str, model: str | None = None,
               prices: DataFrame | None = None) -> DataFrame:
    """Adds ``cost``; models without a price, and rows without a model, use the default.

    The built-in price list is a handful of rows and is broadcast; a list that is
    passed in is joined as the planner sees fit.
    """
    price_in: Column = F.lit(DEFAULT_PRICE[0])
    price_out: Column = F.lit(DEFAULT_PRICE[1])
    if model is not None:
        listed = F.broadcast(price_table(df)) if prices is None else prices
        listed = listed.select(F.col("model").alias("_model"), "price_in", "price_out")
        df = df.join(listed, F.col(model) == F.col("_model"), "left")
        price_in = F.coalesce("price_in", price_in)
        price_out = F.coalesce("price_out", price_out)
    cost = F.col(tokens_in) / 1e6 * price_in + F.col(tokens_out) / 1e6 * price_out
    return df.withColumn("cost", cost).drop("_model", "price_in", "price_out")


def cost_rollup(df: DataFrame, keys: Sequence[str], cost: str = "cost") -> DataFrame:
    """calls and cost per key combination, subtotals and grand total (NULL keys)."""
    return df.rollup(*keys).agg(
        F.count("*").alias("calls"), F.sum(cost).alias("cost"), F.grouping_id().alias("level"))


def cost_sets(df: DataFrame, sets: Sequence[Sequence[str]], cost: str = "cost") -> DataFrame:
    """calls, cost and mean cost for any sets of keys, in one pass.

    ``level`` is the grouping id over all keys in the order of their first mention: a
    key's bit is 1 where it is summed over, so a total isn't taken for a NULL key, whose bit is 0.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.count("*").alias("calls"), F.sum(cost).alias("cost"), F.avg(cost).alias("mean_cost"),
        F.grouping_id().alias("level"))


def call_metrics(log: DataFrame, key: str, time_col: str, ok: Column, order_cols: Sequence[str],
                 cost_col: str | None = None) -> DataFrame:
    """Per agent: calls, successes, success rate, time and cost figures, rounded for display."""
    cost = F.coalesce(cost_col, F.lit(0.0)) if cost_col else F.lit(0.0)
    calls, won = F.count("*"), F.count_if(ok)
    seconds = F.col(time_col)
    return log.groupBy(key).agg(
        calls.alias("total_calls"),
        won.alias("successful_calls"),
        (calls - won).alias("failed_calls"),
        py_round(won / calls * 100, 2).alias("success_rate"),
        py_round(F.sum(seconds), 2).alias("total_time_seconds"),
        py_round(F.sum(seconds) / calls, 3).alias("average_time_seconds"),
        py_round(F.min(seconds), 3).alias("min_time_seconds"),
        py_round(F.max(seconds), 3).alias("max_time_seconds"),
        F.max_by(seconds, _one_order(log, order_cols)).alias("last_execution_time"),
        py_round(F.sum(cost), 4).alias("total_cost"),
        py_round(F.sum(cost) / calls, 6).alias("average_cost"),
    )


def latency_percentiles(log: DataFrame, key: str, time_col: str, ok: Column,
                        accuracy: int | None = None) -> DataFrame:
    """P50, P95, P99 (actual values), calls per second of busy time, error rate.

    Exact: equal values of a key are counted before the shuffle, and the percentiles
    are read off the running counts of distinct values. These are sorted by ranges of
    key and value, so one key of any size is spread over tasks. ``accuracy`` asks for
    a mergeable sketch of bounded size instead.
    """
    calls = F.count("*")
    figures = [calls.alias("calls"),
               (calls / F.nullif(F.sum(time_col), F.lit(0.0))).alias("calls_per_second"),
               ((calls - F.count_if(ok)) / calls).alias("error_rate")]
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if accuracy is not None:
        p = F.percentile_approx(time_col, list(shares.values()), accuracy)
        return log.groupBy(key).agg(p.alias("_p"), *figures).select(
            key, *[F.col("_p")[i].alias(n) for i, n in enumerate(shares)],
            "calls", "calls_per_second", "error_rate")
    value = F.col(time_col)
    counts = log.where(value.isNotNull()).groupBy(key, value.alias("_v")).agg(calls.alias("_n"))
    placed = _running_counts(counts, key)
    found = placed.groupBy(key).agg(*[
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share), F.col("_v"))).alias(name)
        for name, share in shares.items()])
    return group_join(log.groupBy(key).agg(*figures), found, [key]).select(
        key, *shares, "calls", "calls_per_second", "error_rate")


def _running_counts(counts: DataFrame, key: str) -> DataFrame:
    """Add ``_upto``, the sum of ``_n`` over the values ``_v`` of a key up to this one, and ``_all``, over all.

    A range of the sorted table sums what it has of a key. The ranges of a key, of which
    there are as many as partitions at most, are summed up in turn and added.
    """
    cut = written(counts.orderBy(key, "_v").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", key).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("_part", key).agg(F.sum("_n").alias("_sum")).select(
        "_part", key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(key)).alias("_all"))
    each = cut.withColumn("_upto", F.sum("_n").over(inside))
    return group_join(each, parts, ["_part", key], "inner").withColumn("_upto", F.col("_upto") + F.col("_before"))


def _one_order(df: DataFrame, order_cols: Sequence[str]) -> Column:
    """The order columns as one number where that can be, which a hash aggregate can hold; else a struct.

    One whole number or time stands for itself. Of a time and a whole number, the
    microseconds make up the high digits of a decimal.
    """
    kinds = [df.schema[c].dataType for c in order_cols]
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    times = (T.TimestampType, T.TimestampNTZType)
    if len(kinds) == 1 and isinstance(kinds[0], whole + times):
        return F.col(order_cols[0])
    if len(kinds) == 2 and isinstance(kinds[0], times) and isinstance(kinds[1], whole):
        micros = F.unix_micros(F.col(order_cols[0]).cast("timestamp")).cast("decimal(18,0)")
        return micros * F.lit("2" + "0" * 19).cast("decimal(20,0)") + F.col(order_cols[1]).cast("decimal(19,0)")
    return F.struct(*order_cols)


def range_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, failing rows, checked rows; all rules in one pass. NULL counts as failing."""
    counts = df.agg(F.count("*").alias("_n"), *[
        F.count_if(~F.coalesce(condition, F.lit(False))).alias(f"_r{i}")
        for i, condition in enumerate(rules.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"_r{i}").alias("failing"),
                      F.col("_n").alias("checked")) for i, name in enumerate(rules)]
    return counts.select(F.inline(F.array(*pairs)))


def score_rules() -> dict[str, Column]:
    """The value bounds of a scored comment."""
    bounds = [
        F.col("sentiment.label").isin(*SENTIMENTS),
        F.col("sentiment.score").between(0.0, 1.0),
        F.col("emotion.emotion").isin(*EMOTIONS),
        F.col("emotion.confidence").between(0.0, 1.0),
        F.size("topics.topics").between(1, TOPICS_PER_COMMENT),
        F.forall("entities", lambda e: e["confidence"].between(0.0, 1.0)),
    ]
    return dict(zip(RULE_NAMES, bounds))


def latest_state(log: DataFrame, key: str, order_cols: Sequence[str],
                 fields: Mapping[str, str | Column], ts_col: str, status_col: str,
                 final: Sequence[str] = ("completed", "failed")) -> DataFrame:
    """Last known value of each field per job; empty values never overwrite.

    ``fields`` maps output names to columns. Numbers overwrite when not NULL (0
    counts), strings when neither NULL nor empty. Partial aggregation keeps one
    candidate per field and map task, however long a job's log is. On a stream the state
    is one such candidate per field and job; as the order columns decide, not the time of
    arrival, it comes to the same whichever way the log is cut into batches.
    """
    order = _one_order(log, order_cols)
    out = []
    for name, value in fields.items():
        v = F.col(value) if isinstance(value, str) else value
        is_text = isinstance(value, str) and dict(log.dtypes)[value] == "string"
        set_ = v.isNotNull() & (v != "") if is_text else v.isNotNull()
        out.append(F.max_by(v, F.when(set_, order)).alias(name))
    done = F.max(F.when(F.col(status_col).isin(*final), F.col(ts_col)))
    return log.groupBy(key).agg(
        *out, F.min(ts_col).alias("started_at"), F.max(ts_col).alias("updated_at"),
        done.alias("completed_at"))


def time_estimate(rows: Column) -> Column:
    """Whole seconds an analysis of this many comments is announced to take."""
    return (rows * SECONDS_PER_COMMENT).cast("long")
