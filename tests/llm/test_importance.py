import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from voxtab.llm import importance

NAMES = "doc_id long, text string, rank int, score string, buckets int, _place long, able string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def runs(text, sizes):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i:i + n])) % 10000
            for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, sizes=(1, 1), percent=10, least=20):
    s = Counter(b for _, x in rows for b in runs(x, sizes))
    t = Counter(b for x in target for b in runs(x, sizes))
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    out = []
    for i, x in rows:
        f = runs(x, sizes)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
        r.append(True)
    return Counter((*r[:4], r[4] if len(r) > 5 else None) for r in out)


def test_scan_emits_every_run_of_words():
    assert [m[0] for m in importance.ngrams(2).finditer(b"a bb a bb c", overlapped=True)] == [
        b"a bb", b"bb a", b"a bb", b"bb c"]
    text = "One, two;  THREE \u00c9t\u00e9\x00four"
    n, found = importance._scan(text.encode(), [importance.ngrams(k) for k in (1, 2, 3)], 10000)
    assert n == 5 and sorted(found.tolist()) == sorted(runs(text, (1, 3)))


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2)])
def test_equals_a_plain_version(spark, cases, sizes):
    rows = cases * 3
    target = ["alpha beta gamma delta", None, "", "the same text twice"]
    frame = spark.createDataFrame([(*r, 1, "s", 2, 3, "no") for r in rows], NAMES).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(frame, goal, sizes=sizes, percent=30).collect()
    assert Counter(tuple(r) for r in out) == plain(rows, target, sizes, 30)


def test_empty_tables_and_a_repeated_row(spark, empty):
    goal = spark.createDataFrame([], "text string")
    assert importance.resample(empty, goal).count() == 0
    rows = [(1, "one two " * 15)] * 500
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = importance.resample(frame, goal).collect()
    assert sorted(r.rank for r in out if r.rank) == list(range(1, 51)) and len({r.score for r in out}) == 1


def test_a_text_longer_than_a_chunk(spark):
    long = "alpha Beta, " * 500_000
    out = importance.resample(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame(
        [("alpha",)], "text string")).first()
    assert out.n_features == 1_000_000 and out.weight == next(iter(plain([(1, long)], ["alpha"])))[2]
