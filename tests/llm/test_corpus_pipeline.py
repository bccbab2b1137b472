import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from test_decontaminate import plain as plain_windows
from test_secrets import base
from test_simhash import groups, plain as plain_fingerprint
from voxtab.llm import bpe


def test_pipeline_equals_plain_stages(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").collect()
    docs = {r.doc_id: r.text for r in read("documents")}
    docs = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t)}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    part = groups(links, ids)
    items = [(r.item_id, r.text) for r in read("benchmark")]
    vocabulary = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks,
                            special_tokens={})
    want = set()
    for i in ids:
        if part[i] != i or plain_windows(docs[i], items)[1]:
            continue
        text, at, out = docs[i], 0, []
        for start, _, end in base(text):
            if start >= at:
                out.append(text[at:start])
            at = max(at, end)
        text = "[SECRET]".join([*out, text[at:]])
        tokens = enc.encode_ordinary(text)
        want.add((i, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in cp.run(spark, sf).collect()} == want


def test_stages_keep_columns_and_stand_odd_rows(spark, docs, empty, sf):
    wide = docs.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars",
                           "_row", "id as _spans", "n as _before", "id")
    for df in (wide, wide.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns, name
            if df is wide:
                assert 0 < out.count() <= 69
            else:
                assert out.count() == 0
    assert cp.STAGES[-1][1](spark, wide, sf).count() == 69
