from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtab.llm import gru, toxicity


def test_gradient_equals_differences():
    m = gru.Gru(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    w = gru.Words([b"one two three four " * 15, b"five six", b"seven"])
    text, ids = w.windows()
    y = np.array([1, 0, 1, 0, 1])[:len(text)]
    m._x = m.inputs(w)
    grad = m.gradient(w, ids, y, np.ones(len(y)))

    def loss():
        z = m.forward(m.inputs(w), ids)
        return (np.logaddexp(0, z) - y * z).mean()

    for k, g in grad.items():
        flat, at = m.p[k].reshape(-1), int(np.abs(g).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        flat[at] = old
        assert abs(slope - g.reshape(-1)[at]) < 1e-3 * max(1e-3, abs(slope)) + 1e-6, k


def test_windows_cover_texts():
    for n in (0, 1, 39, 40, 41, 60, 61, 200):
        text, ids = gru.Words([b"w " * n]).windows()
        places = {s * gru.STRIDE + k for s in range(len(ids)) for k in range(gru.WINDOW) if ids[s, k] >= 0}
        assert places == set(range(n)) and len(text) == (max(0, -(-(n - 40) // 20)) + 1 if n else 0)


@pytest.mark.parametrize("seed", range(5))
def test_finds_planted_words_in_long_texts(seed):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("aeioulnrst"), 5))
    texts = [" ".join(word() for _ in range(60)).split() for _ in range(300)]
    y = np.arange(300) % 2
    for k in np.flatnonzero(y):
        texts[k][r.integers(60)] = "zzgrumpf"
    texts = [" ".join(t).encode() for t in texts]
    m = gru.Gru(seed)
    m.train(texts[:240], y[:240], seed)
    assert (((m.scores(texts[240:]) >= 0.5) == y[240:]).mean()) > 0.9
    assert m.scores([b"", b"  "]).tolist() == [0, 0]


def test_edges(spark, docs, cases, empty):
    labels = spark.createDataFrame([(90003, 1), (90005, None)], "doc_id long, toxic int")
    out = toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect()
    assert Counter(r.id for r in out) == Counter(i for i, _ in cases)
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score_texts(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score_texts(empty, none).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg("toxic"),
                F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert r[0] > 1 - r[1] and r[2] > 0.8
