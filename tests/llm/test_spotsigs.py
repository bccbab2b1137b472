import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from voxtab.llm import spotsigs as s

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    common = lambda w: len(w) <= 3 or w in s.COMMON
    out = {("^", *words[:2])} if words else set()
    for i, w in enumerate(words):
        chain = [c for c in words[i + 1:i + 1 + s.REACH] if not common(c)][:2]
        if common(w) and len(chain) == 2:
            out.add((w, *chain))
    return out


def like(a, b):
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < max(len(a), len(b)) * s.LEAST:
        return 0.0
    return len(a & b) / len(a | b)


def test_edited_texts_and_likeness_equal_plain_ones(docs, cases):
    out = s.compare_with_edits(docs).collect()
    known = sorted(((i, t or "") for i, t in cases if i is not None), key=lambda x: x)
    last = [t or "" for i, t in cases if i is None]
    ring = known + [(None, t) for t in last]
    want = Counter()
    for k, (i, text) in enumerate(ring):
        follow = ring[(k + 1) % len(ring)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        a = plain(text)
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(plain(edited)),
              round(like(a, plain(edited)), 9), round(like(a, plain(follow)), 9))] += 1
    got = Counter((r.id, r.n_chars, r.edited_sha256, len(r.fingerprint) // 8, len(r.edited_fingerprint) // 8,
                   round(r.near_edited, 9), round(r.near_next, 9)) for r in out)
    assert got == want


def test_ranges_make_no_difference(docs):
    one = s.with_next(docs).collect()
    many = s.with_next(docs, rows_per_bucket=4).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, many))


def test_few_rows(spark, empty):
    assert s.compare_with_edits(empty).count() == 0
    one = s.compare_with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_near_duplicates_equal_all_pairs(spark, cases):
    rows = [(k, t) for k, (_, t) in enumerate(cases[:40])]
    rows += [(100 + k, t[:int(len(t) * 0.93)]) for k, t in rows if k % 3 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r.doc_id: set(r.s) for r in df.select("doc_id", s.signatures(F.col("text")).alias("s")).collect()}
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
            and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in s.near_duplicates(df).collect()} == want and want
