"""Passages of benchmark items in documents, found by an FM-index over each shard of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import (
    WORD_BYTES, as_column, chunks_of, documents, out_batch, read_table, schema_with, words_of, written)
from voxtab.llm.fm_index import FMIndex

WINDOW_WORDS = 10
#: Bytes of documents in one shard, that is in one index. A longer document is its own shard.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark texts searched for in one pass over the documents. A larger
#: benchmark is searched in several passes.
BLOCK_BYTES = 16 << 20


class Windows:
    """The distinct windows of some items as rows of word numbers (2 and up)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW_WORDS):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], dict[int, None]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), {})[k] = None
        self.sizes = np.array([len(w) for w in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for i, w in enumerate(owners):
            self.rows[i, :len(w)] = w
        self.item = np.array(list(chain.from_iterable(owners.values())), np.int64)
        self.item_at = np.cumsum([0, *map(len, owners.values())])
        self.shortest = int(self.sizes.min(initial=window))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and text, first word and window of every occurrence.

        Words that no window has stand for themselves nowhere, so a window can only
        lie in a run of known words that is long enough. The index holds these runs,
        each closed by the symbol 1, and no other part of the shard.
        """
        get = self.number.get
        ids, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            counts[i] = len(words)
            ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))  # no run goes on into the next text
        symbols = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        known = np.diff(np.r_[False, symbols > 0, False].astype(np.int8))
        first, end = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
        long = end - first >= self.shortest
        first, sizes = first[long], (end - first)[long]
        none = np.zeros(0, np.int64)
        if not len(first) or not len(self.rows):
            return counts, none, none, none
        offset = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(int((sizes + 1).sum())) + np.repeat(first - offset, sizes + 1)
        packed = symbols[place].astype(np.int64)
        packed[offset + sizes] = 1
        index = FMIndex(packed, len(self.number) + 1)
        which, at = index.find(self.rows, self.sizes)
        at = place[at]
        begins = np.cumsum(counts + 1) - counts - 1
        text_no = np.searchsorted(begins, at, side="right") - 1
        return counts, text_no, at - begins[text_no], which


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans as disjoint spans in order; touching spans become one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return list(zip(begin[fresh].tolist(), end[np.r_[fresh[1:] - 1, len(end) - 1]].tolist()))


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about ``limit`` bytes, each small enough for the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t.encode()) for r in block.collect() if r.i is not None and r.t is not None]


_FOUND = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def occurrences(df: DataFrame, benchmark: DataFrame, id_col: Column | str = "doc_id",
                text_col: str = "text", window: int = WINDOW_WORDS,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id``, ``n_words``, ``spans`` and ``items`` of every row of ``df``.

    spans: word ranges (end exclusive) that windows of the benchmark cover, merged.
    items: ids of the items with an occurring window, sorted as strings, distinct.

    The benchmark is searched in blocks; with more than one, the rows are found
    again by a row number and their spans and items are merged. NULL texts have no
    words. Items without id or text are left out; items that repeat count once.
    Ids of ``df`` may be NULL or repeated. An empty table gives an empty one.
    """
    cols = df.select(as_column(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = [Windows(b, window) for b in _blocks(benchmark, block_bytes)] or [Windows([], window)]
    if len(blocks) > 1:
        cols = written(cols.withColumn("_row", F.monotonically_increasing_id()))
    keep = [c for c in cols.columns if c != "text"]
    found = [cols.mapInArrow(_searcher(w, keep), schema_with(cols, keep, _FOUND)) for w in blocks]
    if len(blocks) == 1:
        return found[0]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both.groupBy("_row").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"),
        _merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("_row")


def _merge_spans(spans):
    """The same union as ``merged``, as an expression: a fold over the sorted spans."""
    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["begin"] <= F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
                      ).otherwise(F.concat(done, F.array(s)))

    empty = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")
    return F.aggregate(F.array_sort(spans), empty, add)


def _searcher(windows: Windows, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks_of(batches, "text", SHARD_BYTES):
            counts, text_no, at, which = windows.find(texts)
            order = np.argsort(text_no, kind="stable")
            cuts = np.searchsorted(text_no[order], np.arange(len(texts) + 1))
            spans: list[list[dict]] = [[] for _ in texts]
            items: list[list[str]] = [[] for _ in texts]
            for i in np.unique(text_no).tolist():
                own = order[cuts[i]:cuts[i + 1]]
                spans[i] = [{"begin": b, "end": e} for b, e in
                            merged(at[own], at[own] + windows.sizes[which[own]])]
                owners = [windows.item[windows.item_at[w]:windows.item_at[w + 1]]
                          for w in np.unique(which[own]).tolist()]
                items[i] = sorted({windows.names[k] for k in np.concatenate(owners).tolist()})
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield out_batch(batch, keep, n_words=counts, spans=pa.array(spans, kind),
                            items=pa.array(items, pa.list_(pa.string())))

    return run


def summary(found: DataFrame) -> DataFrame:
    """``id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of the spans; what stands between two of them goes as well."""
    if not text or not spans:
        return text
    raw = text.encode()
    flat = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.r_[False, flat, False].astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for begin, stop in spans:
        out.append(raw[at:first[begin]])
        at = end[stop - 1]
    return b"".join([*out, raw[at:]]).decode()


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = summary(occurrences(documents(spark, folder), read_table(spark, folder, "benchmark")))
    return found.withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS i, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT i, array_to_string(list_slice(w, p, p + 9), ' ') AS g,
    least(len(w), 10) AS n
  FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, i FROM gram JOIN win USING (g, n)),
words AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
