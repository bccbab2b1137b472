import base64
import hashlib
import random
import tempfile
from collections import Counter

from voxtab.llm import warc

TRAP = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_round_trip(spark):
    rows = [(3, "http://a/1", "same"), (1, "http://a/WARC/1.1", "same"), (2, "u\r\nX: y", TRAP), (4, None, "x" + TRAP * 3),
            (5, "u", None), (6, "u", ""), (None, "u", "no id"), (7, "u", "é\r\n\r\n"), (7, "u", "é\r\n\r\n"),
            (8, "u", "\r\n\r\n" + TRAP + "WARC/1." * 5), (9, "u", "z" * 200_000 + "\r\n\r\n" + TRAP)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = tempfile.mkdtemp() + "/w"
    warc.write_archives(pages, folder, file_records=2)
    got = Counter(tuple(r) for r in warc.read_pages(spark, folder).collect())
    want, seen = Counter(), {}  # payload: page of its response
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        new = seen.setdefault(raw, i) == i  # a repeated row is a response as well
        want[(i, len(raw), digest, "response" if new else "revisit", None if new else seen[raw])] += 1
    assert got == want


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = tempfile.mkdtemp() + "/w"
    warc.write_archives(pages, folder)
    assert warc.read_pages(spark, folder).count() == 0


def test_chain_leaves_out_what_is_not_reached(spark):
    links = spark.createDataFrame([("f", 0, 10), ("f", 10, 30), ("f", 15, 30), ("f", 30, 99), ("g", 5, 9)],
                                  "file string, start long, stop long")
    assert sorted(tuple(r) for r in warc.reachable(links).collect()) == [("f", 0), ("f", 10), ("f", 30)]


def test_chain_over_cells_of_any_size(spark):
    rng = random.Random(3)
    links, want = [], set()
    for file in "abc":
        starts = sorted({0, *(rng.randrange(4000) for _ in range(300))})
        ends = {s: rng.choice([t for t in starts if t > s][:4] or [5000]) for s in starts}
        ends[starts[7]] = None
        ends[starts[9]] = starts[2]
        links += [(file, s, e) for s, e in ends.items()]
        at = 0
        while at in ends:
            want.add((file, at))
            at = ends[at] if (ends[at] or 0) > at else None
    frame = spark.createDataFrame(links, "file string, start long, stop long")
    for size in (1, 64, 1000, 1 << 20):
        got = [tuple(r) for r in warc.reachable(frame, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
