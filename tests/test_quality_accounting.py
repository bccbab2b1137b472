import itertools
import json

import pytest
from pyspark.sql import functions as F

from voxtab.functions import markdown as M
from voxtab.functions import text as X
from voxtab.operators import accounting as A
from voxtab.operators import quality as Q


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("```markdown\n# Title\nContent\n```", "# Title\n\nContent"),
    ("  \n```\nplain\n```\n", "plain"),
    ("```python\nx\n```", "```python\nx"),
    ("# A\n\n\n\n\nB\n## C\n# D\ntext", "# A\n\nB\n## C\n# D\n\ntext"),
    ("  x \x1c", "x"),
])
def test_clean_markdown(spark, raw, want):
    assert one(spark, M.clean_markdown, raw) == want


def test_headings(spark):
    text = "# Main\n## **Bold Section**\n## __U__\n#### deep\n### Sub 2.1  \n##none\n text ## no"
    assert one(spark, M.section_headings, text) == ["Bold Section", "U", "Sub 2.1"]


@pytest.mark.parametrize("raw, want", [
    ("```json\n{}\n```", "{}"), (" {} ", "{}"), ("```", ""), ("```a\nb\nc\nd", "b\nc")])
def test_strip_fence(spark, raw, want):
    assert one(spark, M.strip_fence, raw) == want


def test_word_and_token_counts(spark):
    assert one(spark, X.word_count, "  a b\n c ") == 3
    assert one(spark, X.word_count, "") == 0
    assert one(spark, X.token_estimate, "x" * 11) == 2


def test_heuristic_scores_of_all_combinations(spark):
    want = [64.0, 70.0, 68.5, 74.5, 68.5, 74.5, 73.0, 79.0]
    rows = []
    for i, (long, heads, advice) in enumerate(itertools.product([0, 1], repeat=3)):
        rows.append((i, ("word " * 201 if long else "word ") + ("## h " if heads else "")
                     + ("I Recommend it" if advice else "")))
    got = Q.evaluate_text(spark.createDataFrame(rows, "id long, t string"), "t").orderBy("id")
    for r, score in zip(got.collect(), want):
        assert r.evaluation.overall_score == score
        assert r.evaluation.should_regenerate == (score < 70)
        assert r.status == ("fail" if score < 70 else "pass") and len(r.evaluation.checks) == 5


CRITICAL = {"overall_score": 75.0, "should_regenerate": True, "issues": ["wrong"], "feedback": "fix",
            "checks": {"coherence": {"score": 80.0}, "factual_accuracy": {
                "score": 40, "issues": ["bad"], "critical": True}}}


def test_parsed_evaluations(spark):
    good = dict(CRITICAL, should_regenerate=False, checks={"coherence": {"score": 80.0}})
    no_score = dict(CRITICAL, checks={"coherence": {"critical": True}})
    answers = [json.dumps(CRITICAL), f"```json\n{json.dumps(good)}\n```", "invalid json {",
               json.dumps(no_score), None]
    df = spark.createDataFrame([(i, "text", a) for i, a in enumerate(answers)],
                               "id long, t string, a string")
    out = Q.evaluate_text(df, "t", answer_col="a").withColumn(
        "rule", Q.must_regenerate(F.col("evaluation"))).orderBy("id").collect()
    assert [r.status for r in out] == ["fail", "pass", "fail", "fail", "fail"]
    assert [r.evaluation.overall_score for r in out] == [75.0, 75.0, 64.0, 64.0, 64.0]
    assert [r.rule for r in out] == [True, False, True, True, True]
    assert out[0].evaluation.checks["coherence"].issues == []
    rows = Q.explode_criteria(Q.evaluate_text(df, "t", answer_col="a"), ["id"])
    assert rows.where("id = 0").count() == 2 and rows.where("id = 2").count() == 5


def test_attempts(spark):
    log = [(1, 1, 60.0, True), (1, 2, 80.0, False), (1, 3, 90.0, False),
           (2, 1, 66.0, True), (2, 2, 55.0, True),
           (3, 1, 75.0, False), (4, 1, 1.0, True), (4, 2, 2.0, True), (4, 3, 3.0, True),
           (4, 4, 99.0, False)]
    df = spark.createDataFrame(log, "report long, attempt int, quality_score double, "
                                    "should_regenerate boolean").withColumn("c", F.lit(0.01))
    got = {r.report: r for r in Q.select_attempt(df, "report", cost_cols=["c", "c"],
                                                 plan_cost=0.1).collect()}
    assert [(got[i].attempts, got[i].quality_score, got[i].final_status) for i in (1, 2, 3, 4)] == [
        (2, 80.0, "passed"), (2, 55.0, "max_attempts_reached"), (1, 75.0, "passed"),
        (3, 3.0, "max_attempts_reached")]
    assert got[1].total_cost == pytest.approx(0.14)
    assert [(h.attempt, h.status) for h in got[1].history] == [(1, "fail"), (2, "pass")]
    best = {r.report: r for r in Q.select_attempt(df, "report", pick="best").collect()}
    assert best[2].quality_score == 66.0 and best[2].chosen_attempt == 1
    overview = Q.attempt_overview(Q.select_attempt(df, "report")).first()
    assert (overview.reports, overview.mean_attempts, overview.pct_max_attempts) == (4, 2.0, 50.0)


def test_costs(spark):
    df = spark.createDataFrame(
        [("claude-3-opus-20240229", 1000, 500), ("other", 1000, 500), (None, 1000, 500)],
        "model string, i long, o long")
    got = {r.model: r.cost for r in A.token_cost(df, "i", "o", "model").collect()}
    assert got["other"] == got[None] == pytest.approx(0.0105)
    assert got["claude-3-opus-20240229"] == pytest.approx(0.0525)
    assert A.token_cost(df, "i", "o").first().cost == pytest.approx(0.0105)
    own = spark.createDataFrame([("other", 1.0, 1.0)], A.PRICE_SCHEMA)
    own_cost = A.token_cost(df, "i", "o", "model", own).where("model = 'other'").first().cost
    assert own_cost == pytest.approx(0.0015)
    roll = A.cost_rollup(A.token_cost(df, "i", "o", "model"), ["model", "i"])
    assert roll.where("level = 3").first().calls == 3


def test_call_metrics(spark):
    log = [("w", 1, 1.0, True, 0.5), ("w", 2, 3.0, False, None), ("w", 3, 2.0, True, 0.25)]
    df = spark.createDataFrame(log, "agent string, n long, sec double, ok boolean, cost double")
    r = A.call_metrics(df, "agent", "sec", F.col("ok"), ["n"], "cost").first()
    assert (r.total_calls, r.successful_calls, r.failed_calls, r.success_rate) == (3, 2, 1, 66.67)
    assert (r.total_time_seconds, r.average_time_seconds, r.last_execution_time) == (6.0, 2.0, 2.0)
    assert (r.min_time_seconds, r.max_time_seconds, r.total_cost, r.average_cost) == (
        1.0, 3.0, 0.75, 0.25)


def test_percentiles_are_values(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("agent"), F.col("id").cast("double").alias("s"))
    r = A.latency_percentiles(df, "agent", "s", F.lit(True)).first()
    assert (r.p50, r.p95, r.p99, r.error_rate) == (50.0, 95.0, 99.0, 0.0)


def test_percentiles_over_many_ranges(spark):
    """One key has nearly all rows, one has NULL for a name, one has no value; ranges cut keys."""
    rows = [("a", float(i * i % 9973)) for i in range(6000)] + [(None, float(i)) for i in range(7)] + [("z", None), ("y", 5.0)]
    df = spark.createDataFrame(rows, "agent string, s double").repartition(9)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.agent: (r.p50, r.p95, r.p99, r.calls) for r in A.latency_percentiles(df, "agent", "s", F.lit(True)).collect()}
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", was)
        a = sorted(float(i * i % 9973) for i in range(6000))
        assert got == {"a": (a[2999], a[5699], a[5939], 6000), None: (3.0, 6.0, 6.0, 7),
                       "z": (None, None, None, 1), "y": (5.0, 5.0, 5.0, 1)}


def test_grouping_sets_keep_null_keys_apart(spark):
    df = spark.createDataFrame([("r", None, 1.0), ("r", "s", 2.0), (None, "s", 4.0)], "report string, stage string, cost double")
    got = {(r.report, r.stage, r.level): (r.calls, r.cost) for r in A.cost_sets(
        df, [["report", "stage"], ["report"], ["stage"], []]).collect()}
    assert got == {("r", None, 0): (1, 1.0), ("r", "s", 0): (1, 2.0), (None, "s", 0): (1, 4.0), ("r", None, 1): (2, 3.0),
                   (None, None, 1): (1, 4.0), (None, None, 2): (1, 1.0), (None, "s", 2): (2, 6.0), (None, None, 3): (3, 7.0)}


def test_job_state_ignores_empty_values(spark):
    log = [(1, 1, "queued", 0.0, "Queued", None), (1, 2, "running", 20.0, "", None),
           (1, 3, None, 0.0, "Cleaning", None), (1, 4, "failed", None, None, "boom"),
           (2, 1, "queued", None, "Queued", None)]
    df = spark.createDataFrame(log, "job long, t long, status string, progress double, "
                                    "stage string, error string").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = {r.job: r for r in A.latest_state(
        df, "job", ["ts"], {"status": "status", "progress": "progress", "stage": "stage",
                            "error": "error"}, "ts", "status").collect()}
    assert (got[1].status, got[1].progress, got[1].stage, got[1].error) == (
        "failed", 0.0, "Cleaning", "boom")
    assert got[1].completed_at == got[1].updated_at and got[2].completed_at is None
    assert got[2].progress is None


def test_range_checks_and_estimates(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "v double")
    r = A.range_checks(df, {"unit": F.col("v").between(0, 1)}).first()
    assert (r.rule, r.failing, r.checked) == ("unit", 2, 3)
    assert spark.range(7).agg(A.time_estimate(F.count("*"))).first()[0] == 10
