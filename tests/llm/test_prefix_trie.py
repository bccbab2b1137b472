import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from voxtab.llm import prefix_trie

NAMES = "conv_id long, turn long, role string, text string, depth string, owner int, conv int, n string"


def plain(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            stored[c].append((turn is not None, turn or 0, digest, role, text))
    rebuilt = {}
    for c, own in stored.items():
        own.sort()
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = [t[3:] for t in sorted(stored.get(base, []))[:h] + own[h:]]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    n_children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += not n_children[p]
    ends = {p: ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(p)) for p, who in members.items()}
    return Counter((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), n_children[p], leaves[p], saved[p],
                    hashlib.sha256(ends[p].encode()).hexdigest()) for p, who in members.items())


def trie(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], NAMES).repartition(parts)
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(frame).collect())


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_plain_version(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 150), -5, -100, 100_003, 10**12]:
        if c != 100:
            for turn in range(r.choice([1, 2, 3, 5, 7, 9])):
                rows.append((c, r.choice([turn, turn, turn, 3, None]), r.choice(["user", "bot", None, ""]),
                             r.choice(["a", "", None, "\u00e9\U0001F600"])))
    rows += rows[:20] + [(None, 1, "user", "a"), (None, None, None, None)]
    assert trie(spark, rows) == plain(rows)


def test_long_conversations_and_many_copies(spark):
    """One conversation holds a third of all turns; many are alike; ranges and blocks are cut all over."""
    r = random.Random(3)
    rows = [(40, t, "user", r.choice("ab")) for t in range(6000)]
    rows += [(c, t, role, text) for c in (140, 141) for _, t, role, text in rows[:5000]]
    rows += [(c, t, "user", "same") for c in range(200, 700) for t in range(7)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        short = [x for x in rows if x[0] >= 200 or x[1] < 60]
        assert trie(spark, short) == plain(short)
        out = trie(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    deep = max(out, key=lambda x: x[1])
    assert deep[:2] == (40, 6000 - zlib.crc32(b"40") % 6) and deep[3:7] == (1, 0, 1, 0)
    root = next(x for x in out if x[1] == 0)
    assert root[0] == 40 and root[3] == 503


def test_empty_table_and_lone_rows(spark):
    assert trie(spark, [(None, 1, "user", "a")]) == Counter()
    for rows in ([(3, None, None, None)], [(0, 1, "user", "a")], [(7, t, "u", "b") for t in range(9)]):
        assert trie(spark, rows) == plain(rows)


def test_colliding_fingerprints_are_seen(spark):
    """Bases of zero ignore all turns but the first, so sequences meet that differ later."""
    rows = [(c, t, "u", f"{c * (t > 0)}") for c in range(200, 260) for t in range(9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stored = prefix_trie.stored_turns(frame)
    prefixes = prefix_trie.prefix_products(stored, (0, 0, 0, 0))
    joined = prefixes.selectExpr("conv", "pos as depth", "f1", "f2", "p1", "p2", "g1", "g2", "g3", "g4", "n")
    assert not prefix_trie._nodes(joined)[1]
    good = prefix_trie.prefix_products(stored).selectExpr(
        "conv", "pos as depth", "f1", "f2", "p1", "p2", "g1", "g2", "g3", "g4", "n")
    assert prefix_trie._nodes(good)[1]
