import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxtab.llm import suffix_dedup as sd


def plain(rows):
    count = Counter(b[a:a + 200] for _, b in rows for a in range(len(b) - 199))
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - 199):
            if count[b[a:a + 200]] > 1:
                gone[a:a + 200] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        yield i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("piece", [1 << 18, 300])
def test_removed_bytes_equal_a_plain_search(spark, piece, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", piece)
    random.seed(3)
    p = "".join(random.choice("abc dé") for _ in range(500))
    rows = [(1, None), (2, ""), (3, "a" * 450), (3, "a" * 199), (4, p + "x" + p[:230]), (5, "zz" + p[100:310]),
            (6, "q" * 10 + p[1:400]), (None, "ab" * 300), (7, "\x00" * 205), (8, "\x00" * 201), (9, p), (9, p)]
    rows += [(10 + k, "".join(random.choice("ab") for _ in range(700)) + p[k:k + 190]) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sd.remove_repeats(df).collect()
    got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == Counter(plain([(i, (t or "").encode()) for i, t in rows]))


def test_edges(docs, cases, empty, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_ROWS", 3)
    out = sd.remove_repeats(docs).collect()
    got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == Counter(plain([(i, (t or "").encode()) for i, t in cases]))
    assert sd.remove_repeats(empty).count() == 0


def test_multikey_order_and_prefixes():
    r = np.random.default_rng(0)
    rows = r.integers(0, 2, (300, 40)).astype(np.uint8)
    rows[50:90] = rows[10]
    order, prefix = sd.multikey_order(rows)
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered) and prefix[0] == 0
    for a, b, n in zip(ordered, ordered[1:], prefix[1:]):
        assert a[:n] == b[:n] and (n == 40 or a[n] != b[n])
