import random
from collections import Counter

import numpy as np
import pytest

from voxtab.llm import decontaminate as d
from voxtab.llm.common import words_of
from voxtab.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


def plain(text, items, window=10):
    words = words_of((text or "").encode())
    hit, found = [False] * len(words), set()
    for name, item in items:
        w = words_of((item or "").encode())
        for g in {tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} - {()}:
            for i in range(len(words) - len(g) + 1):
                if tuple(words[i:i + len(g)]) == g:
                    hit[i:i + len(g)] = [True] * len(g)
                    found.add(str(name))
    spans, at = [], 0
    while at < len(hit):
        if hit[at]:
            end = at
            while end < len(hit) and hit[end]:
                end += 1
            spans.append((at, end))
            at = end
        at += 1
    return len(words), tuple(spans), tuple(sorted(found))


@pytest.mark.parametrize("seed", range(5))
def test_fm_index_finds_all_places(seed):
    r = np.random.default_rng(seed)
    text = r.integers(1, 4, 300)
    assert suffix_array(np.r_[text, 0]).tolist() == sorted(range(301), key=lambda i: np.r_[text, 0][i:].tolist())
    patterns = np.array([r.integers(1, 4, 4) for _ in range(20)])
    sizes = r.integers(1, 5, 20)
    which, at = FMIndex(text, 3).find(patterns, sizes)
    want = [(k, i) for k in range(20) for i in range(300)
            if text[i:i + sizes[k]].tolist() == patterns[k][:sizes[k]].tolist()]
    assert sorted(zip(which.tolist(), at.tolist())) == want
    tree = WaveletMatrix(text, 3)
    assert tree.access(np.arange(300)).tolist() == text.tolist()


def test_occurrences_equal_a_plain_search(spark, docs, cases, empty):
    random.seed(1)
    texts = [t for _, t in cases if t]
    items = [(1, texts[0][:400]), (2, "The  Same!"), (3, ""), (4, None), (5, texts[3][50:300]), (5, texts[3][50:300]),
             (None, "text"), (6, "gamma of DELTA alpha beta the gamma of delta alpha beta the"), (7, "never there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = [(i, t) for i, t in items if i is not None]
    want = Counter((i, *plain(t, real)) for i, t in cases)
    for block in (1 << 20, 200):
        out = d.occurrences(docs, bench, block_bytes=block).collect()
        got = Counter((r.id, r.n_words, tuple(tuple(s) for s in r.spans), tuple(r["items"])) for r in out)
        assert got == want, block
    assert d.occurrences(empty, bench).count() == 0
    assert d.occurrences(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_spans_are_cut_out():
    assert d.without_spans("a, b c! d. e", [(1, 3)]) == "a, ! d. e"
    assert d.without_spans("é b", [(0, 2)]) == "" and d.without_spans(None, []) is None
