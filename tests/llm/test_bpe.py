import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from voxtab.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks,
                             special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_digests_equal_the_library(spark, docs, cases, vocabulary, library, empty):
    more = [(1, "a" * 5000 + " " + "中文" * 400), (2, "  \t\n x  y 's 'S 12³ ½ \x1c\x85  z  <|endoftext|>")]
    every = cases + more
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = Counter()
    for i, text in every:
        ids = library.encode_ordinary(text or "")
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))] += 1
    for hot in (bpe.HOT_WORDS, 50, 0):
        assert Counter(tuple(r) for r in bpe.digests(df, vocabulary, hot=hot).collect()) == want
    assert bpe.digests(empty, vocabulary).count() == 0


def test_ids_and_decoding(docs, cases, vocabulary, library):
    out = bpe.encoded(docs, vocabulary).withColumn("back", bpe.decoded(F.col("ids"), vocabulary)).collect()
    assert Counter((r.id, tuple(r.ids), bytes(r.back)) for r in out) == Counter(
        (i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in cases)


def test_heap_merges_like_the_library(vocabulary, library):
    random.seed(1)
    for _ in range(300):
        word = "".join(random.choice("abeéthrsn中") for _ in range(random.randint(1, 200)))
        assert bpe.merged_by_heap(word.encode(), vocabulary.ranks) == library.encode_ordinary(word)
