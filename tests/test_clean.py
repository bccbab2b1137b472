import random
import re

import pytest
from pyspark.sql import functions as F

from voxtab.constants import SPAM_PATTERNS
from voxtab.functions import text as X
from voxtab.operators import clean as C

PIECES = [
    "Hello", "world", "<b>", "</b>", "<", ">", "a < b", "http://x.y/z?q=1", "www.site.org", "http",
    " ", "  ", "\t", "\n", " ", " ", "\x1c", "\x85", "!!!", "!!!!!!", "$$$", "€€", "FREE",
    "win", "winnow", "now", "BUY", "click", "here", "this", "Viagra", "ÀÉÎ", "straße", "LOUD TEXT",
    "ok", "x", "ſ", "viſit", "vısıt", "<!-- c -->", "1 <2> 3",
]


def brute_clean(s):
    for pattern, repl in [(r"<[^>]+>", ""), (r"http\S+|www\.\S+", ""), (r"\s+", " ")]:
        s = re.sub(pattern, repl, s)
    return s.strip()


def brute_reason(raw, clean):
    if raw is None:
        return "missing"
    if clean == "":
        return "empty"
    if len(clean) < 3:
        return "short"
    loud = sum(map(str.isupper, clean))
    if any(re.search(p, clean.lower(), re.I) for p in SPAM_PATTERNS):
        return "spam"
    return "spam" if len(clean) > 10 and loud / len(clean) > 0.7 else None


def brute_marks(texts):
    seen, marks = set(), []
    for raw in texts:
        clean = None if raw is None else brute_clean(raw)
        reason = brute_reason(raw, clean)
        if reason is None and clean in seen:
            reason = "duplicate"
        elif reason is None:
            seen.add(clean)
        marks.append((clean, reason))
    return marks


@pytest.fixture(scope="module")
def messy():
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    return [None if rng.random() < 0.03 else t for t in texts]


@pytest.fixture(scope="module")
def frame(spark, messy):
    return spark.createDataFrame(list(enumerate(messy)), "id long, text string").repartition(5)


def test_every_row_is_judged_as_by_brute_force(frame, messy):
    got = C.classify(frame, "text", "id").orderBy("id").collect()
    want = brute_marks(messy)
    assert [(r.clean_text, r.removal_reason) for r in got] == want
    assert {w[1] for w in want} == {None, "missing", "empty", "short", "spam", "duplicate"}


def test_kept_rows_ledger_and_stats(frame, messy):
    want = brute_marks(messy)
    kept = {i: c for i, (c, r) in enumerate(want) if r is None}
    assert {r.id: r.text for r in C.clean(frame, "text", "id").collect()} == kept
    ledger = {r.reason: r.cnt for r in C.removal_ledger(frame, "text").collect()}
    assert sum(ledger.values()) == len(messy)
    for reason in ("missing", "empty", "short", "spam", "duplicate"):
        assert ledger[reason] == sum(r == reason for _, r in want)
    stats = C.data_stats(frame, "text").first()
    lengths = [len(t) for t in kept.values()]
    assert (stats.min_text_length, stats.max_text_length) == (min(lengths), max(lengths))
    assert stats.avg_text_length == pytest.approx(sum(lengths) / len(lengths))
    assert stats.removed_rows == len(messy) - len(kept)


def test_cleaning_kept_rows_again_changes_nothing(frame):
    kept = C.clean(frame, "text", "id")
    tagless = kept.where(~F.col("text").rlike("[<>]") & ~F.contains("text", F.lit("http")))
    again = C.clean(tagless, "text", "id")
    assert again.exceptAll(tagless).isEmpty() and tagless.exceptAll(again).isEmpty()


def test_groups_are_cleaned_apart(frame):
    grouped = frame.withColumn("g", F.col("id") % 3)
    together = C.clean(grouped, "text", "id", ["g"])
    for g in range(3):
        alone = C.clean(grouped.where(F.col("g") == g), "text", "id")
        both = together.where(F.col("g") == g)
        assert alone.exceptAll(both).isEmpty() and both.exceptAll(alone).isEmpty()


@pytest.mark.parametrize("texts, status, n_warnings", [
    ([f"a perfectly fine remark number {i}" for i in range(50)], "pass", 0),
    ([f"remark number {i} is fine" for i in range(20)] + [""] * 35, "warning", 1),
    (["same remark again"] * 12, "fail", 1),
    ([f"tiny {i}" for i in range(30)], "pass", 1),
    ([""] * 20, "fail", 1),
])
def test_verdict(spark, texts, status, n_warnings):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    row = C.validation_verdict(C.data_stats(df, "text")).first()
    assert (row.status, len(row.warnings)) == (status, n_warnings)


def test_verdict_of_nothing_kept_has_no_lengths(spark):
    df = spark.createDataFrame([(None,)] * 12, "text string")
    row = C.validation_verdict(C.data_stats(df, "text")).first()
    assert row.missing == 12 and row.avg_text_length is None and row.status == "fail"


def test_known_texts(spark):
    rows = [("Check this link http://example.com out", "Check this link out", "spam"),
            ("<p>HTML tag here</p> with content", "HTML tag here with content", None),
            ("  Multiple   spaces   here  ", "Multiple spaces here", None),
            ("Visit www.example.com today", "Visit today", None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id long, text string")
    got = C.classify(df, "text", "id").orderBy("id").collect()
    assert [(r.clean_text, r.removal_reason) for r in got] == [r[1:] for r in rows]


def test_long_texts_do_not_stall(spark):
    hard = ["<" * 60_000, "http " + "a " * 40_000, "win " * 30_000, "! " * 40_000]
    df = spark.createDataFrame(list(enumerate(hard)), "id long, text string")
    assert C.classify(df, "text", "id").count() == 4
    assert df.where(X.is_spam(F.col("text"))).count() == 0


def test_one_scan_and_no_repeated_cleaning(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    staged = C._judged(stored, "text")._jdf.queryExecution().executedPlan().toString()
    assert staged.count("<[^>]+>") == 1 and staged.count("FileScan") == 1
    rest = C.clean(stored, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert rest.count("<[^>]+>") == 0 and str(tmp_path / "in") not in rest


def test_raw_texts_are_not_staged_and_few_repeats_do_not_move_texts(spark, frame, monkeypatch):
    staged, real = [], C.written
    monkeypatch.setattr(C, "written", lambda d: staged.append(d.columns) or real(d))
    kept = C.clean(frame, "text", "id")
    assert "text" not in staged[0] and "clean_text" in staged[0]
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "FEW_IDS", 0)
    shuffled = C.clean(frame, "text", "id")
    assert "ShuffledHashJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    assert kept.exceptAll(shuffled).isEmpty() and shuffled.exceptAll(kept).isEmpty()


def test_language_guess(spark):
    df = spark.createDataFrame(
        [(i, "zzz" if i % 3 == 0 else "this is it") for i in range(40)], "id long, text string")
    assert C.language_guess(df, "text", "id").first().language == "en"
    df = spark.createDataFrame([(i, "zzz") for i in range(40)], "id long, text string")
    assert C.language_guess(df, "text", "id").first().language == "unknown"
