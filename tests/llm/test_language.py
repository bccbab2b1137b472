from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxtab.llm import language


def plain_ranks(text, keep):
    runs = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
    flat = " " + " ".join(runs) + " " if runs else ""
    grams = Counter()
    for n in (1, 2, 3):
        grams.update(flat[i:i + n] for i in range(len(flat) - n + 1))
    grams.pop(" ", None)
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:keep]


def test_ranked_ngrams_equal_a_plain_count(cases, monkeypatch):
    monkeypatch.setattr(language, "SPAN", 1000)
    for _, text in cases:
        got, _ = language.ranked_ngrams((text or "").encode(), keep=50)
        assert got.tolist() == plain_ranks(text, 50)


def test_distance_is_out_of_place():
    p = language.Profiles({"x": np.array([5, 9, 7], np.uint64), "y": np.array([9], np.uint64)}, keep=4)
    assert p.names == ["x", "y"]
    name, score, like = language.Profiles({"q": language.ranked_ngrams(b"abc abd", keep=9)[0]}, 9).guess(b"abc abd")
    assert (name, like) == ("q", 1.0) and 0 <= score <= 1


def test_held_out_accuracy(spark, sf):
    out = language.op1_language(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"),
                                  F.max("score")).first()
    assert r[0] > 0.97 and r[1] >= 0 and r[2] <= 1


def test_edges(docs, cases, empty):
    profiles = language.learn(docs)
    out = language.identify(docs, profiles).collect()
    assert Counter(r.id for r in out) == Counter(i for i, _ in cases)
    und = {r.id for r in out if r.lang_pred == "und"}
    assert und == {90001, 90002, 90004} and all(r.score == 0 for r in out if r.id in und)
    assert language.identify(empty, language.learn(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learn(empty)).collect()} == {"und"}
