import random
import re
from collections import Counter

import numpy as np
import xxhash

from voxtab.llm import simhash as s
from voxtab.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def groups(links, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints_and_groups_equal_plain_ones(docs, cases, empty):
    out = s.near_duplicates(docs).collect()
    fps = [plain(t) for _, t in cases]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    part = groups(links, range(len(fps)))
    first = {}
    for k, (i, _) in enumerate(cases):
        if i is not None:
            first[part[k]] = min(i, first.get(part[k], i))
    want = Counter((i, fps[k], first.get(part[k])) for k, (i, _) in enumerate(cases))
    assert Counter((r.id, r.fp % 2**64, r.component) for r in out) == want
    assert s.near_duplicates(empty).count() == 0


def test_links_of_close_fingerprints_are_whole(spark):
    random.seed(2)
    fps = set()
    for _ in range(40):
        base = random.getrandbits(64)
        for _ in range(30):
            fps.add(base)
            for _ in range(random.randint(1, 4)):
                base ^= 1 << random.randrange(64)
    rows = [(f - 2**64 if f >> 63 else f,) for f in fps]
    nodes = [r[0] for r in rows]
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if ((a ^ b) % 2**64).bit_count() <= 4]
    got = {r.fp: r.component for r in s.linked(spark.createDataFrame(rows, "fp long")).collect()}
    want = groups(links, nodes)
    assert got == {n: want[n] for link in links for n in link}


def test_forest_of_a_dense_group_is_one_link_a_member():
    fps = np.array([1 << b for b in range(60)], np.uint64)
    assert len(s.forest(fps, 4)) == 59


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").union(
        spark.createDataFrame([(1000, 1001), (1001, 1001), (None, 3)], "a long, b long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {n: 0 for n in range(301)} | {1000: 1000, 1001: 1000}
