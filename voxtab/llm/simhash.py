"""SimHash fingerprints and the groups of documents whose fingerprints nearly agree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import chunks_of, documents, out_batch, schema_with, written
from voxtab.llm.components import components
from voxtab.operators.skew import split_join

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Blocks of a fingerprint. With 4 differing bits at least 3 of 7 blocks are equal.
BLOCKS = 7
#: Bits of hashes unpacked at once.
HASHES_AT_ONCE = 1 << 15
#: Blocks with up to so many fingerprints are compared together with other blocks.
SMALL_GROUP = 32


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a UTF-8 text; 0 if it has no word.

    A bit is set if it is set in over half of the shingle hashes (XXH64, seed 42),
    repeats counted.
    """
    tokens = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(flat, 42)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[:1 - words].tolist(), ends[words - 1:].tolist())
    hashes = np.array([digest(flat[i:j], 42) for i, j in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[k:k + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fp`` (a signed long) of every row; a NULL text counts as empty."""
    cols = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks_of(batches, "text"):
            fp = np.array([simhash(t) for t in texts], np.uint64).view(np.int64)
            yield out_batch(batch, ["id"], fp=fp)

    return cols.mapInArrow(run, schema_with(cols, ["id"], "fp long"))


def _masks(blocks: int, distance: int) -> list[int]:
    """For every choice of ``blocks - distance`` blocks, a mask over their bits (signed)."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that hold together what links of at most ``distance`` bits hold together.

    A walk from fingerprint to fingerprint over those not yet reached. Within a
    dense group the first steps reach nearly all, so it makes one link per member.
    """
    links, rest = [], fps
    while rest.size:
        reached, rest = [rest[0]], rest[1:]
        while reached and rest.size:
            x = reached.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(x, f) for f in found]
                reached.extend(found)
    return links


def _links(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (choice, part); rows come sorted by these."""
    held: list[np.ndarray] = []
    last = None

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        fps, links = rows[:, 2].copy().view(np.uint64), []
        for s, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
            links += forest(fps[s:s + n], distance)
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        for k in range(1, min(SMALL_GROUP, int(sizes.max()))):
            same = (group[k:] == group[:-k]) & small[k:]
            at = np.flatnonzero(same)
            at = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= distance]
            links += list(zip(fps[at], fps[at + k]))
        if links:
            a, b = np.array(links, np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy() for c in batch.columns])
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut or (last is not None and (rows[0, :2] != last).any()):
            yield from solve(np.concatenate([*held, rows[:cut]]))
            held = []
        held.append(rows[cut:])
        last = rows[-1, :2].copy()
    if held:
        yield from solve(np.concatenate(held))


def linked(distinct: DataFrame, distance: int = MAX_DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``fp`` and ``component`` (smallest fp reachable) of the fingerprints that have a link.

    distinct: one row per fingerprint. Two fingerprints at most ``distance`` bits
    apart agree in at least ``blocks - distance`` blocks, so they meet under the
    choice of those blocks. More blocks make longer keys and fewer chance meetings
    at the price of more rows: 7 blocks have 35 keys of 27 bits.
    """
    masks = F.array(*[F.lit(m) for m in _masks(blocks, distance)])
    parts = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        F.col("choice").cast("long"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    met = parts.repartition("choice", "part").sortWithinPartitions("choice", "part")
    links = met.mapInArrow(lambda it: _links(it, distance), "a long, b long")
    return components(links).withColumnRenamed("node", "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` and ``component`` (smallest id reachable) of every row.

    Equal fingerprints are one node, so copies are never paired. NULL texts and
    texts without words have fingerprint 0 and are linked like any other. NULL ids
    are kept but never name a component, unless no member has an id. Repeated rows
    come out as often as they came in. An empty table gives an empty one.
    """
    own = written(fingerprints(df, id_col, text_col))
    groups = _groups(own)
    names = groups.groupBy("component").agg(F.min("first").alias("name"))
    named = groups.join(names, "component").select("fp", "n", F.col("name").alias("component"))
    return split_join(own, written(named), ["fp"], "n").select("id", "fp", "component")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``: the smallest id of each component, one row per component."""
    groups = _groups(written(fingerprints(df, id_col, text_col)))
    return groups.groupBy("component").agg(F.min("first").alias("id")).select("id")


def _groups(own: DataFrame) -> DataFrame:
    """``fp``, its smallest id ``first``, its number of rows ``n`` and ``component`` (a fingerprint)."""
    nodes = written(own.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    return nodes.join(linked(nodes.select("fp")), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(documents(spark, folder))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
