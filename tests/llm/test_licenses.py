import re
from collections import Counter

from voxtab.llm import licenses
from voxtab.llm.license_texts import BASE_PHRASES, NOTICES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hits = [(k, label) for phrase, label in BASE_PHRASES for k in range(len(words))
            if words[k:k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in hits})))


def test_base_phrases_equal_a_plain_search(spark, docs, cases, empty):
    out = licenses.scan_licenses(docs).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter((i, *plain(t)) for i, t in cases)
    assert licenses.scan_licenses(empty).count() == 0


def test_each_notice_is_found_in_prose(spark):
    prose = "the quick brown fox and any other words of the story without end " * 20
    rows = [(k, prose + text + " " + prose) for k, (_, text, _) in enumerate(NOTICES)]
    rows += [(100, prose), (101, "APACHE license; MIT\nLicense mit license")]
    out = {r.id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _, _) in enumerate(NOTICES):
        assert label in out[k].labels.split(","), label
        assert 0.9 <= out[k].score <= 1
    assert out[100].labels == "" and out[100].score == 0
    assert (out[101].base_labels, out[101].n_base, out[101].first_word, out[101].last_word) == ("apache,mit", 3, 0, 4)


def test_changed_notice_needs_its_key_phrase(spark):
    text = " ".join(NOTICES[0][1].split())
    rows = [(1, text.replace("sublicense", "x y z")), (2, text.replace("without restriction", "with some"))]
    out = {r.id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "mit", 2: ""}
