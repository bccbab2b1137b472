"""The stateless and windowed parts of the analysis on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtab.operators.clean import drop_unusable
from voxtab.operators.score import score


def clean_and_score(stream: DataFrame, text_col: str,
                    scorers: Sequence[str] = ("sentiment", "emotion", "topics")) -> DataFrame:
    """Cleaning without dedup, then scoring: row by row, the same on streams and tables."""
    return score(drop_unusable(stream, text_col), text_col, scorers)


def drop_repeats(stream: DataFrame, text_col: str, ts_col: str, delay: str) -> DataFrame:
    """Drop texts seen before within the watermark delay.

    State is kept for that long only, so this is not the global keep-first of the
    batch form, and rows later than the watermark are dropped.
    """
    keyed = stream.withWatermark(ts_col, delay).withColumn(
        "_key", F.unhex(F.sha2(text_col, 256)))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def feed(batches: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], folder: str,
         mode: str = "append") -> DataFrame:
    """What a stream over files puts out when the files come in batches, with a stop after each.

    Every batch is added to the source folder and run to its end by a new stream over the
    same checkpoint, so state and watermark come from the batches before. ``append`` gives all
    rows put out; ``complete`` the state after the last batch. ``folder`` is shared and empty.
    """
    spark, schema = batches[0].sparkSession, batches[0].schema
    put = f"{folder}/out"
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/in")
        made = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        writer = made.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        if mode == "append":
            run = writer.format("parquet").option("path", put).start()
        else:
            run = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{put}/{n % 2}")).start()
        run.awaitTermination()
        last = run.lastProgress
    if mode == "append":
        return spark.read.schema(made.schema).parquet(put)
    return spark.read.schema(made.schema).parquet(f"{put}/{last['batchId'] % 2}")


def label_counts(scored: DataFrame, ts_col: str, label: str, width: str,
                 slide: str | None = None, delay: str | None = None) -> DataFrame:
    """window_start, label, cnt by tumbling or sliding windows; ``delay`` sets a watermark."""
    if delay is not None:
        scored = scored.withWatermark(ts_col, delay)
    window = F.window(ts_col, width, slide) if slide else F.window(ts_col, width)
    counts = scored.groupBy(window.alias("_w"), F.col(label).alias("label")).agg(
        F.count("*").alias("cnt"))
    return counts.select(F.col("_w.start").alias("window_start"), "label", "cnt")


def period_comparison(events: DataFrame, ts_col: str, label: str, unit: str = "week") -> DataFrame:
    """Per period and label: cnt, share, and the change of both to the period just before.

    A label that a period lacks counts 0 there, if the label stands in the period
    before it; changes are NULL where the period before has no event at all. The
    joins and windows run over one row per period and label, not over the events.
    """
    period = F.date_trunc(unit, ts_col).cast(events.schema[ts_col].dataType).alias("period")
    counts = events.groupBy(period, F.col(label).alias("label")).agg(F.count("*").alias("cnt"))
    share = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("period"))
    now = counts.withColumn("share", share)
    after = (F.expr(f"timestampadd({unit}, 1, period)")).cast(now.schema["period"].dataType)
    before = now.select(after.alias("_period"), F.col("label").alias("_label"),
                        F.col("cnt").alias("_cnt"), F.col("share").alias("_share"))
    same = (F.col("period") == F.col("_period")) & F.col("label").eqNullSafe(F.col("_label"))
    both = now.join(before, same, "full").select(
        F.coalesce("period", "_period").alias("period"),
        F.when(F.col("period").isNull(), F.col("_label")).otherwise(F.col("label")).alias("label"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("share", F.lit(0.0)).alias("share"),
        "_cnt", "_share", F.col("period").isNotNull().alias("_here"))
    # Periods that have events, and those that follow one.
    w = Window.partitionBy("period")
    both = both.withColumn("_any", F.max("_here").over(w)).withColumn(
        "_after", F.max(F.col("_cnt").isNotNull()).over(w)).where("_any")
    return both.select(
        "period", "label", "cnt", "share",
        F.when(F.col("_after"), F.col("cnt") - F.coalesce("_cnt", F.lit(0))).alias("cnt_change"),
        F.when(F.col("_after"), F.col("share") - F.coalesce("_share", F.lit(0.0))).alias("share_change"))
