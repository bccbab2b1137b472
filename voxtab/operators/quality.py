"""Grading of report texts, parsed evaluations, and the choice among attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtab.constants import CRITERION_WEIGHTS, MIN_REPORT_SCORE
from voxtab.functions.markdown import strip_fence
from voxtab.functions.text import word_count
from voxtab.functions.values import compute_once, let
from voxtab.schemas import CRITERION, EVALUATION


def heuristic_evaluation(text: Column, min_score: float = MIN_REPORT_SCORE) -> Column:
    """struct(overall_score, should_regenerate, checks, issues, feedback) from the text alone."""
    facts = F.struct(
        (word_count(text) > 200).alias("long"),
        F.contains(text, F.lit("##")).alias("headers"),
        F.contains(F.lower(text), F.lit("recommend")).alias("advice"),
    )

    def points(flag: Column, value: float) -> Column:
        return F.when(flag, value).otherwise(0.0)

    def criterion(score: Column, issue: Column | None = None) -> Column:
        issues = F.array_compact(F.array(issue)) if issue is not None else F.array()
        return F.struct(score.alias("score"), issues.cast("array<string>").alias("issues"),
                        F.lit(False).alias("critical")).cast(CRITERION)

    def body(f: Column) -> Column:
        completeness = (F.lit(50.0) + points(f["long"], 15.0) + points(f["headers"], 15.0)
                        + points(f["advice"], 10.0))
        scores = {
            "completeness": completeness,
            "factual_accuracy": F.lit(80.0),
            "coherence": F.lit(70.0),
            "actionability": F.when(f["advice"], 60.0).otherwise(40.0),
            "hallucination": F.lit(90.0),
        }
        issue = {
            "completeness": F.when(~f["long"], "Report too short"),
            "actionability": F.when(~f["advice"], "No recommendations found"),
        }
        overall = F.lit(0.0)
        for name, weight in CRITERION_WEIGHTS.items():
            overall = overall + scores[name] * F.lit(weight)
        checks = F.create_map(*[
            x for n in CRITERION_WEIGHTS
            for x in (F.lit(n), criterion(scores[n], issue.get(n)))])
        return let(overall, lambda o: F.struct(
            o.alias("overall_score"),
            (o < min_score).alias("should_regenerate"),
            checks.alias("checks"),
            F.array(F.lit("Fallback evaluation used - LLM unavailable")).alias("issues"),
            F.lit("Report generated but quality could not be fully evaluated.")
            .alias("feedback"),
        ).cast(EVALUATION))

    return let(facts, body)


def parsed_evaluation(answer: Column) -> Column:
    """Evaluation struct from a JSON answer; NULL unless its required fields are there."""
    parsed = F.from_json(strip_fence(answer), EVALUATION, {"allowSingleQuotes": "false"})
    none = F.array().cast("array<string>")

    def filled(_: Column, c: Column) -> Column:
        return F.struct(c["score"].alias("score"), F.coalesce(c["issues"], none).alias("issues"),
                        F.coalesce(c["critical"], F.lit(False)).alias("critical"))

    return let(parsed, lambda e: F.when(
        e["overall_score"].isNotNull() & e["should_regenerate"].isNotNull()
        & F.forall(F.map_values(e["checks"]), lambda c: c["score"].isNotNull()),
        F.struct(
            e["overall_score"].alias("overall_score"),
            e["should_regenerate"].alias("should_regenerate"),
            F.transform_values(e["checks"], filled).alias("checks"),
            F.coalesce(e["issues"], none).alias("issues"),
            e["feedback"].alias("feedback"),
        ).cast(EVALUATION)))


def evaluate_text(df: DataFrame, text_col: str, min_score: float = MIN_REPORT_SCORE,
                  answer_col: str | None = None) -> DataFrame:
    """Adds ``evaluation`` and ``status``: a parsed answer where there is one, else the heuristic."""
    own = heuristic_evaluation(F.col(text_col), min_score)
    if answer_col is not None:
        own = F.coalesce(parsed_evaluation(F.col(answer_col)), own)
    return df.withColumn("evaluation", compute_once(own)).withColumn(
        "status", F.when(F.col("evaluation.should_regenerate"), "fail").otherwise("pass"))


def must_regenerate(evaluation: Column, min_score: float = MIN_REPORT_SCORE) -> Column:
    """The decision rule itself: a low score or any critical criterion."""
    critical = F.exists(F.map_values(evaluation["checks"]),
                        lambda c: F.coalesce(c["critical"], F.lit(False)))
    return (evaluation["overall_score"] < min_score) | critical


def explode_criteria(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (text, criterion): criterion, score, issues, critical."""
    return df.select(*keep, F.explode("evaluation.checks").alias("criterion", "_c")).select(
        *keep, "criterion", "_c.score", "_c.issues", "_c.critical")


# --- attempts --------------------------------------------------------------------------


def played_attempts(attempts: DataFrame, key: str, attempt: str = "attempt",
                    regenerate: str = "should_regenerate", max_attempts: int = 3) -> DataFrame:
    """Attempts up to the first that passes, or to ``max_attempts``.

    Rows past ``max_attempts`` go before the window, so no report brings more than
    that many rows to one task.
    """
    ok = F.when(~F.col(regenerate), F.col(attempt))
    first_ok = F.min(ok).over(Window.partitionBy(key))
    tried = attempts.where(F.col(attempt) <= max_attempts)
    return tried.withColumn("first_ok", first_ok).where(
        F.col("first_ok").isNull() | (F.col(attempt) <= F.col("first_ok")))


def select_attempt(attempts: DataFrame, key: str, attempt: str = "attempt",
                   score: str = "quality_score", regenerate: str = "should_regenerate",
                   max_attempts: int = 3, pick: str = "last",
                   cost_cols: Sequence[str] = (), plan_cost: float = 0.0) -> DataFrame:
    """One row per report: chosen attempt and score, attempts, final_status, total_cost, history.

    ``pick="last"`` keeps the attempt at which the loop ended; ``pick="best"`` the
    one with the highest score (the earliest on a tie).
    """
    cost = F.lit(0.0)
    for c in cost_cols:
        cost = cost + F.coalesce(c, F.lit(0.0))
    played = played_attempts(attempts, key, attempt, regenerate, max_attempts)
    order = F.struct(attempt) if pick == "last" else F.struct(F.col(score), -F.col(attempt))
    chosen = F.max_by(F.struct(F.col(attempt).alias("attempt"), F.col(score).alias("score")), order)
    one = F.struct(F.col(attempt).alias("attempt"), F.col(score).alias("quality_score"),
                   F.when(F.col(regenerate), "fail").otherwise("pass").alias("status"),
                   cost.alias("cost"))
    return played.groupBy(key).agg(
        chosen.alias("_chosen"),
        F.count("*").alias("attempts"),
        F.when(F.max("first_ok").isNotNull(), "passed").otherwise("max_attempts_reached")
        .alias("final_status"),
        (F.lit(plan_cost) + F.sum(cost)).alias("total_cost"),
        F.sort_array(F.collect_list(one)).alias("history"),
    ).select(key, F.col("_chosen.attempt").alias("chosen_attempt"),
             F.col("_chosen.score").alias("quality_score"), "attempts", "final_status",
             "total_cost", "history")


def attempt_statistics(chosen: DataFrame) -> DataFrame:
    """Per number of attempts: reports, share of all, share that passed."""
    counts = chosen.groupBy("attempts").agg(
        F.count("*").alias("reports"),
        F.count_if(F.col("final_status") == "passed").alias("passed"))
    return counts.withColumn("pct", F.col("reports") * 100.0 / F.sum("reports").over(
        Window.partitionBy()))


def attempt_overview(chosen: DataFrame) -> DataFrame:
    """One row: reports, mean attempts, share that ended at the limit."""
    at_max = (F.col("final_status") == "max_attempts_reached").cast("double")
    return chosen.agg(F.count("*").alias("reports"), F.avg("attempts").alias("mean_attempts"),
                      (F.avg(at_max) * 100).alias("pct_max_attempts"))
