import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import EMOTIONS, TOPIC_STOP_WORDS
from voxtab.functions import scoring as S
from voxtab.operators import score as SC
from voxtab.operators import summarise as U
from voxtab.operators.skew import split_join


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text, want", [
    ("good, this. wow!!! .....  ok", ["good", "this", "wow", ""]),
    ("a b c", ["general"]),
    ("Great battery life and excellent camera quality with fast performance.",
     ["great", "battery", "excellent", "camera", "quality"]),
    ("their Their! THEIR other other", ["their", "other"]),
    ("", ["general"]),
])
def test_topics(spark, text, want):
    got = one(spark, S.topics, text)
    assert got.topics == want and got.primary_topic == want[0]
    assert got.relevance_scores == {t: 1 / (i + 1) for i, t in enumerate(want)}


@pytest.mark.parametrize("text, label", [
    ("The best, an excellent buy", "positive"), ("Terrible and useless", "negative"),
    ("It arrived", "neutral"), ("good but bad", "neutral"), ("great " * 500, "positive"),
])
def test_sentiment(spark, text, label):
    got = one(spark, S.sentiment, text)
    assert got.label == label and got.score == max(got.scores.values())
    assert math.isclose(sum(got.scores.values()), 1.0)


def test_sentiment_of_no_hits(spark):
    assert one(spark, S.sentiment, "It arrived").score == pytest.approx(0.78699, abs=1e-5)


def test_emotion(spark):
    got = one(spark, S.emotion, "I am so happy and delighted")
    assert got.emotion == "joy" and set(got.scores) == set(EMOTIONS)
    tie = one(spark, S.emotion, "angry and sad")
    assert tie.emotion == "anger"
    assert one(spark, S.emotion, "a table").emotion == "neutral"


def test_entities_have_exact_offsets(spark):
    text = "Mail Jo Smith at jo.smith@x.org, pay $1,200.50 by 2024-03-01 or see https://a.b/C d﷐"
    got = one(spark, S.entities, text)
    assert [(e.text, e.type) for e in got] == [
        ("Mail Jo Smith", "MISC"), ("jo.smith@x.org", "EMAIL"), ("$1,200.50", "MONEY"),
        ("2024-03-01", "DATE"), ("https://a.b/C", "URL")]
    assert all(text[e.start:e.end] == e.text for e in got)
    assert one(spark, S.entities, "nothing here") == []


def test_earlier_rule_keeps_its_span(spark):
    got = one(spark, S.entities, "https://a.org/2024-03-01/x@y.com")
    assert [e.type for e in got] == ["DATE", "EMAIL"]


def test_gazetteer(spark):
    df = spark.createDataFrame(
        [(1, "We like New York City and New York. Newark no."), (2, "nothing"),
         (3, "mail a@york.org from York")], "id long, text string")
    names = spark.createDataFrame(
        [("New York", "CITY"), ("New York City", "CITY"), ("York", "TOWN"), ("New York", "STATE")],
        "name string, type string").dropDuplicates(["name"])
    got = SC.entities_with_gazetteer(df, "text", "id", names).select("id", "text", F.explode(
        "entities").alias("e")).orderBy("id", "e.start").collect()
    assert [(r.id, r.e.text) for r in got] == [
        (1, "New York City"), (1, "New York"), (3, "a@york.org"), (3, "York")]
    assert all(r.text[r.e.start:r.e.end] == r.e.text for r in got)
    empty = SC.entities_with_gazetteer(df, "text", "id", names.limit(0))
    assert empty.where("id = 1").first().entities[0].type == "MISC"


def brute_keyphrases(texts, keep=10):
    grams = {}
    for i, text in texts.items():
        toks = [w.strip(".,!?;:\"'") for w in text.lower().split()
                if len(w) > 4 and w not in TOPIC_STOP_WORDS]
        seq = []
        for j, tok in enumerate(toks):
            seq.append((2 * j, tok.strip(" ")))
            if j + 1 < len(toks):
                seq.append((2 * j + 1, f"{tok} {toks[j + 1]}".strip(" ")))
        grams[i] = [(p, g) for p, g in seq if len(g) > 2]
    df = Counter(g for seq in grams.values() for g in {x for _, x in seq})
    out = {}
    for i, seq in grams.items():
        tf, first = Counter(g for _, g in seq), {}
        for p, g in seq:
            first.setdefault(g, p)
        raw = {g: n * math.log(1 + len(texts) / df[g]) for g, n in tf.items()}
        best = sorted(raw, key=lambda g: (-raw[g], first[g]))[:keep]
        out[i] = [(g, raw[g] / raw[best[0]]) for g in best]
    return out


def test_keyphrases_equal_brute_force_with_a_hot_phrase(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i:03d}" for i in range(60)] + ["short", "......", "their"]
    texts = {i: " ".join(["always hot"] + rng.choices(vocabulary, k=rng.randint(0, 12)))
             for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {}
    for r in SC.keyphrases(df, "text", "id", 10).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.phrase, r.score))
    want = brute_keyphrases(texts)
    assert {i: [p for p, _ in v] for i, v in got.items()} == {
        i: [p for p, _ in v] for i, v in want.items() if v}
    for i, v in got.items():
        assert [s for _, s in v] == pytest.approx([s for _, s in want[i]])


def test_rows_without_phrases_get_the_empty_record(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "wonderful weather")], "id long, text string")
    got = {r.id: r.keyphrases for r in SC.with_keyphrases(df, "text", "id").collect()}
    assert got[1].keyphrases == [] and got[1].scores == {}
    assert got[2].keyphrases == ["wonderful", "wonderful weather", "weather"]


def test_phrases_are_neither_written_nor_shuffled(spark, monkeypatch):
    texts = {i: f"always hot number{i % 7} and number{i % 11}" for i in range(50)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    staged = []
    monkeypatch.setattr(SC, "written", lambda d: staged.append(d.columns) or d)
    for frame in (SC.keyphrases(df, "text", "id", 3), SC.with_keyphrases(df, "text", "id")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not staged and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("least", [1, 40, 1 << 20])
def test_keyphrases_in_blocks_of_any_size_hold_groups_and_repeated_ids(spark, monkeypatch, least):
    monkeypatch.setattr(SC, "LEAST_BYTES", least)
    rng = random.Random(4)
    vocabulary = [f"word{i:02d}" for i in range(15)] + ["......", "their"]
    rows = [(i, g, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9))))
            for i, g in enumerate([None, "", "a"] * 12)] + [(90, "a", None), (91, "b", "lonely words")]
    df = spark.createDataFrame(rows, "id long, g string, text string")
    want = {}
    for group in (None, "", "a", "b"):
        for i, best in brute_keyphrases({i: t or "" for i, g, t in rows if g == group}, 4).items():
            want[i] = [(group, p) for p, _ in best]
    got = {}
    for r in SC.keyphrases(df, "text", "id", 4, ["g"]).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.g, r.phrase))
    assert got == {i: v for i, v in want.items() if v}
    twice = SC.keyphrases(df.union(df), "text", "id", None, ["g"]).groupBy("id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("phrase").alias("d"))
    assert all(r.n == r.last == 2 * r.d for r in twice.collect())
    parts = spark.createDataFrame([(1, "x", "sunny morning"), (1, "y", "rainy evening")], df.schema)
    assert {(r.g, r.phrase) for r in SC.keyphrases(parts, "text", "id", None, ["g"]).collect()} == {
        ("x", "sunny"), ("x", "sunny morning"), ("x", "morning"),
        ("y", "rainy"), ("y", "rainy evening"), ("y", "evening")}


def test_keyphrases_of_odd_tokens_need_no_array_functions(spark):
    odd = "".join(f"Straße{chr(c)}" for c in (0x1c, 0x1f, 0x85, 0xa0, 0x1680, 0x2003, 0x2028, 0x3000, 9, 32))
    texts = {1: odd, 2: "..... Quick!! ;;;;;; 'quick' quick:", 3: "!!!!ab ...... ,,,,c again again", 4: "..... !!!!!",
             5: "ÉCLAIR\u200bs thing \x01\x02\x03\x04\x05 𝒳𝒴𝒵𝒜𝒝 𝒳𝒴𝒵𝒜", 6: "", 7: "their these"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    found, got = SC.keyphrases(df, "text", "id"), {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.phrase, pytest.approx(r.score)))
    assert got == {i: v for i, v in brute_keyphrases(texts, None).items() if v}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_long_results_come_in_batches(monkeypatch):
    monkeypatch.setattr(SC, "BATCH_ROWS", 4)
    rows = pa.table({"id": [1, 2], "_text": ["sunny morning rainy evening", "sunny evening"], "_g1": [0, 0], "_g2": [0, 0]})
    counts = SC._add_up(SC._packer(3)((pa.scalar(0),), rows))
    out = SC._attacher("id", ["id"], [], None, False)(rows, counts)
    assert out.num_rows == 10 and max(b.num_rows for b in out.to_batches()) == 4


def test_records_keep_every_row_and_column(spark):
    rows = [(1, "wonderful weather", [1]), (None, "wonderful weather", None), (3, None, [2, 3]), (4, "a", [])]
    df = spark.createDataFrame(rows, "id long, text string, more array<int>")
    got = SC.with_keyphrases(df, "text", "id")
    assert got.columns == ["id", "text", "more", "keyphrases"]
    assert sorted(((r.id, r.text, r.more, len(r.keyphrases.keyphrases)) for r in got.collect()), key=str) == sorted(
        ((*r, 3 if r[0] == 1 else 0) for r in rows), key=str)
    assert SC.with_keyphrases(df.limit(0), "text", "id").count() == 0


def test_scorer_subset_and_defaults(spark):
    df = spark.createDataFrame([(1, "good")], "id long, text string")
    row = SC.score(df, "text", ["sentiment"]).first()
    assert row.emotion.emotion == "neutral" and row.emotion.confidence == 0.0
    assert row.emotion.scores == {"neutral": 1.0} and row.keyphrases.keyphrases == []
    assert "topics" not in row


def test_user_model_runs_in_batches_and_fails_loudly(spark):
    def counting():
        return lambda texts: [len(t) + 1000 * len(texts) for t in texts]

    def broken():
        def run(texts):
            raise RuntimeError("model failed")
        return run

    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "id long, text string").coalesce(1)
    got = SC.apply_scorer(df, "text", counting, "n", T.LongType(), 32).collect()
    assert Counter(r.n // 1000 for r in got) == {32: 64, 6: 6}
    with pytest.raises(ValueError):
        SC.apply_scorer(df, "text", counting, "n", T.LongType(), 0)
    with pytest.raises(Exception, match="model failed"):
        SC.apply_scorer(df, "text", broken, "n", T.LongType()).collect()


def test_each_distinct_text_is_scored_once(spark):
    texts = ["hot"] * 600 + [f"t{i}" for i in range(400)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    scored = []

    def scorer(t):
        scored.append(t.count())
        return t.withColumn("n", F.length("text"))

    got = SC.score_distinct(df, "text", scorer).collect()
    assert scored == [402] and len(got) == 1005
    assert all(r.n == (None if r.text is None else len(r.text)) for r in got)


def test_split_join_equals_plain_join(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(
        F.col("id") % 500).alias("k"))
    dim = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    got, want = split_join(big, dim, ["k"], "n", parts=10), big.join(dim, "k")
    cols = ["id", "k", "n", "x"]
    assert got.select(cols).exceptAll(want.select(cols)).isEmpty() and got.count() == 3000


def test_comment_ids_number_rows_in_id_order(spark):
    df = spark.range(0, 3000, 7).repartition(6)
    got = {r.id: r.comment_id for r in SC.comment_ids(df, "id").collect()}
    assert got == {i: f"comment_{n}" for n, i in enumerate(range(0, 3000, 7))}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    nouns = ["battery", "camera", "screen", "price", "service", "their", "Acme Corp", "Blue Sky"]
    moods = ["great", "terrible", "plain", "awful", "happy"]
    rows = [(i, ["a", "b", None][i % 3], f"{rng.choice(moods)} {rng.choice(nouns)} with {rng.choice(nouns)} "
             f"{rng.choice(nouns)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, text string").repartition(7)
    return SC.score(df, "text").persist()


def by_count(items, k):
    counts = {}
    for key, value in items:
        counts.setdefault(key, []).append(value)
    return sorted(counts.items(), key=lambda x: -len(x[1]))[:k]


def values(rows):
    number = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}
    return [(r, number[r.sentiment.label]) for r in rows]


def test_topic_summary_equals_brute_force(scored):
    rows = scored.orderBy("id").collect()
    want = by_count([(t, (v, r.text[:100])) for r, v in values(rows)
                     for t in r.topics.topics[:3]], 10)
    got = U.topic_summary(scored, "text", "id").orderBy("rank").collect()
    assert [(r.topic, r.cnt) for r in got] == [(t, len(v)) for t, v in want]
    for r, (_, v) in zip(got, want):
        assert r.avg_sentiment == pytest.approx(sum(x for x, _ in v) / len(v))
        assert r.sample_comments == [s for _, s in v[:5]]


def test_entity_summary_equals_brute_force(scored):
    rows = scored.orderBy("id").collect()
    want = by_count([((e.text, e.type), (v, r.text[:100])) for r, v in values(rows)
                     for e in r.entities], 20)
    got = U.entity_summary(scored, "text", "id").orderBy("rank").collect()
    assert [((r.text, r.type), r.cnt) for r in got] == [(t, len(v)) for t, v in want]
    for r, (_, v) in zip(got, want):
        assert r.sentiment == pytest.approx(sum(x for x, _ in v) / len(v))
        assert r.contexts == [s for _, s in v[:3]]


def test_groups_equal_separate_runs(scored):
    topics = U.topic_summary(scored, "text", "id", group_cols=["g"])
    ents = U.entity_summary(scored, "text", "id", group_cols=["g"])
    dist = U.sentiment_distribution(scored, ["g"])
    for g in ["a", "b", None]:
        part = scored.where(F.col("g").eqNullSafe(g))
        for whole, alone in [(topics, U.topic_summary(part, "text", "id")),
                             (ents, U.entity_summary(part, "text", "id")),
                             (dist, U.sentiment_distribution(part))]:
            mine = whole.where(F.col("g").eqNullSafe(g)).drop("g").select(alone.columns)
            assert sorted(map(str, mine.collect())) == sorted(map(str, alone.collect()))


def test_distributions_add_up(scored):
    for dist in (U.sentiment_distribution(scored), U.emotion_distribution(scored)):
        rows = dist.collect()
        assert sum(r.cnt for r in rows) == 300
        assert sum(r.pct for r in rows) == pytest.approx(100.0)


def test_mean_confidence_without_emotions(spark):
    df = spark.createDataFrame([(1, "good"), (2, "x")], "id long, text string")
    row = U.mean_confidence(SC.score(df, "text", ["sentiment"])).first()
    assert row.emotion_confidence is None and row.confidence == row.sentiment_confidence


def test_ids_near_the_top_of_the_range(spark):
    df = spark.createDataFrame([(2**59 + i, "Acme Corp camera") for i in range(3)],
                               "id long, text string")
    s = SC.score(df, "text")
    assert U.entity_summary(s, "text", "id").first().cnt == 3
    assert U.topic_summary(s, "text", "id").first().cnt == 3


def test_cached_scores_run_once_per_text(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def scorer(texts):
        calls.add(texts.count())
        return texts.withColumn("size", F.length("text"))

    one = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id long, text string")
    two = spark.createDataFrame([(6, "bb"), (7, "ccc")], "id long, text string")
    folder = str(tmp_path / "scores")
    got = [{(r.id, r.text, r.size) for r in SC.cached_scores(df, "text", scorer, folder, ["size"]).collect()}
           for df in (one, two, one, one.limit(0))]
    assert got[0] == got[2] == {(1, "a", 1), (2, "bb", 2), (3, "a", 1), (4, None, 0), (5, "", 0)}
    assert got[1] == {(6, "bb", 2), (7, "ccc", 3)} and got[3] == set()
    assert calls.value == spark.read.parquet(folder).count() == 4
