"""Removal of long byte strings that stand in more than one place, by a sparse suffix array.

A window is a string of ``WIN`` bytes. Every window names one of its own places: that
where the hash of the next ``LEAD`` bytes is smallest (the leftmost of equal ones). The
choice depends on the window alone, so equal windows name the same place within
themselves, and only suffixes that start at named places need sorting: about one in 85.

1. Hashes of leads are counted. Those that occur twice go into a bit sketch of bounded
   size; a chance hit in it costs a row and changes nothing.
2. Named suffixes with a repeated lead are dealt into ranges of their leading bytes by
   sampled splitters, with as much text on both sides as their windows cover.
3. Each bucket sorts the texts to the right of its suffixes, and those to the left read
   backwards, by multikey quicksort with the lengths of common prefixes. For each offset
   of the named place in a window, windows are equal if they lie in one run of both orders.

Splitters never part equal leads, and equal windows have equal leads; within a bucket,
what the sort has to compare may lie in two Arrow batches, so a batch's last lead is
carried over to the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import chunks_of, documents, numbered, out_batch, schema_with, written

WIN = 200
LEAD = 32
#: Window starts hashed at once; positions within a piece take 20 bits.
PIECE = 1 << 18
#: Bits of the sketch: 64 for each repeated lead, within these powers of two (128 KB to 64 MB).
SKETCH_BITS = (20, 29)
#: Documents from which splitters are drawn, about. Results don't depend on them.
SPLITTER_DOCS = 2000
#: Suffixes sorted together, at least; one lead's suffixes are never parted.
BATCH_ROWS = 20_000

_BASE = 0x9E3779B97F4A7C15


def _lead_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``LEAD`` bytes from each place on; LEAD is a power of two."""
    h, base, width = raw.astype(np.uint64) + np.uint64(1), _BASE, 1
    while width < LEAD:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & 0xFFFFFFFFFFFFFFFF, 2 * width
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    got, done = values, 1
    while done * 2 <= width:
        got = np.minimum(got[:-done], got[done:])
        done *= 2
    rest = width - done
    return np.minimum(got[:len(got) - rest], got[rest:]) if rest else got


def named_places(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Named place, first and last window start that name it, and lead hash.

    raw: texts one after the other; starts: where each begins, and the end of the
    last. Windows across two texts are left out. A place may come out twice, for
    two ranges of windows.
    """
    found = [[], [], [], []]
    valid = np.zeros(len(raw) + 1, np.int32)
    long = np.diff(starts) >= WIN
    np.add.at(valid, starts[:-1][long], 1)
    np.add.at(valid, starts[1:][long] - WIN + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    low = np.uint64((1 << 20) - 1)
    for base in range(0, len(raw) - WIN + 1, PIECE):
        stop = min(base + PIECE, len(raw) - WIN + 1)
        hashes = _lead_hashes(raw[base:stop + WIN - 1])
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_min(keys, WIN - LEAD + 1) & low).astype(np.int64)
        good = valid[base:stop]
        place[~good] = -1
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        real = place[first] >= 0
        first, last = first[real], last[real]
        found[0].append(place[first] + base)
        found[1].append(first + base)
        found[2].append(last + base)
        found[3].append(hashes[place[first]])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    flat = b"".join(texts)
    return flat, np.frombuffer(flat, np.uint8), np.cumsum([0, *map(len, texts)])


def _prefix(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 7 bytes of leads as numbers in the order of the bytes."""
    out = np.zeros(len(at), np.int64)
    for k in range(7):
        out = out << 8 | raw[at + k]
    return out


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the common prefix of each with the one before it in that order.

    Multikey quicksort: rows that agree so far are split by their next key (8 bytes),
    those with equal keys go on to the one after; all tied groups are split at once.
    """
    keys = rows.view(">u8")
    order, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    prefix = np.full(len(rows), rows.shape[1], np.int64)
    tied = np.arange(len(rows))
    for c in range(keys.shape[1]):
        if len(tied) < 2:
            break
        key, own = keys[order[tied], c].astype(np.uint64), group[tied]
        by = np.lexsort([key, own])
        order[tied], key = order[tied[by]], key[by]
        new = np.r_[False, (own[1:] == own[:-1]) & (key[1:] != key[:-1])]
        differ = key[new] ^ key[np.flatnonzero(new) - 1]
        same = sum((differ < np.uint64(1 << 64 - 8 * j)).astype(np.int64) for j in range(1, 8))
        prefix[tied[new]] = 8 * c + same
        edge = np.r_[True, own[1:] != own[:-1]] | new
        group[tied] = tied[np.maximum.accumulate(np.where(edge, np.arange(len(tied)), 0))]
        size = np.diff(np.r_[np.flatnonzero(edge), len(tied)])
        tied = tied[np.repeat(size > 1, size)]
    if len(rows):
        prefix[0] = 0
    return order, prefix


def repeated_windows(context: list[bytes], off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which windows of the suffixes stand more than once: one row a suffix, one column an offset.

    context: text from the first window's start to the last one's end; off: place of
    the suffix in it; n: number of windows. Offset o is the place of the suffix in a window.
    """
    # copies of a whole context repeat each other; one of each goes into the sort
    seen: dict[tuple[int, bytes], int] = {}
    one = np.array([seen.setdefault((o, c), len(seen)) for o, c in zip(off.tolist(), context)])
    copies = np.bincount(one)
    _, pick = np.unique(one, return_index=True)
    high = off[pick]
    low = high - n[pick] + 1
    right = np.zeros((len(pick), WIN), np.uint8)
    left = np.zeros((len(pick), WIN), np.uint8)
    for k, (i, h) in enumerate(zip(pick.tolist(), high.tolist())):
        text = np.frombuffer(context[i], np.uint8)
        right[k, :len(text) - h] = text[h:]
        left[k, :h] = text[:h][::-1]
    (r_order, r_prefix), (l_order, l_prefix) = multikey_order(right), multikey_order(left)
    marks = np.zeros((len(pick), WIN - LEAD + 1), bool)
    r_run, l_run = np.empty(len(pick), np.int64), np.empty(len(pick), np.int64)
    for o in range(WIN - LEAD + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if not len(own):
            continue
        r_run[r_order] = np.cumsum(r_prefix < WIN - o)
        l_run[l_order] = np.cumsum(l_prefix < o)
        both = r_run[own] * (len(pick) + 1) + l_run[own]
        by = np.argsort(both)
        same = both[by[1:]] == both[by[:-1]]
        marks[own[by[1:][same]], o] = marks[own[by[:-1][same]], o] = True
    offsets = np.arange(WIN - LEAD + 1)
    marks |= (copies > 1)[:, None] & (low[:, None] <= offsets) & (offsets <= high[:, None])
    return marks[one]


def _bucket_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte spans to remove, from suffixes sorted by lead."""
    def solve(table: pa.Table) -> pa.RecordBatch | None:
        lead = np.array(table.column("lead").to_pylist(), f"S{LEAD}")
        same = lead[1:] == lead[:-1]
        some = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if not len(some):
            return None
        table = table.take(pa.array(some))
        row, at, off, n = (table.column(c).to_numpy() for c in ("_row", "at", "off", "n"))
        marks = repeated_windows(table.column("context").to_pylist(), off.astype(np.int64),
                                 n.astype(np.int64))
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(row[i]), pa.array(at[i] - end + 1), pa.array(at[i] - first + WIN)],
            names=["_row", "begin", "end"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lead = batch.column(batch.schema.get_field_index("lead")).to_pylist()
        cut = len(lead)
        while cut and lead[cut - 1] == lead[-1]:
            cut -= 1
        fresh = bool(held) and bool(lead) and held[-1].column("lead")[-1].as_py() != lead[0]
        if size >= BATCH_ROWS and (cut or fresh):
            held.append(batch.slice(0, cut))
            if (made := solve(pa.Table.from_batches(held))) is not None:
                yield made
            held, size = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        size += len(batch)
    if held and (made := solve(pa.Table.from_batches(held))) is not None:
        yield made


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``_row``, ``begin``, ``end``: byte spans of repeated windows; spans of a text may overlap.

    texts: columns ``_row`` and ``text``, read several times, so rows must not change.
    """
    spark = texts.sparkSession

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in chunks_of(batches, "text"):
            _, raw, starts = _joined(own)
            h, n = np.unique(named_places(raw, starts)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.uint64).view(np.int64)), pa.array(n)], names=["h", "n"])

    twice = written(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(
        F.sum("n").alias("n")).where("n > 1").select("h"))
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], int(64 * twice.count()).bit_length()))
    spot = F.col("h").bitwiseAND((1 << bits) - 1)
    cells = twice.select(F.shiftright(spot, 15).alias("cell"), spot.bitwiseAND(32767).alias("bit")).groupBy(
        "cell").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    sketch = np.zeros(1 << bits - 3, np.uint8)
    for r in cells:
        sketch[r.cell << 12:r.cell + 1 << 12] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(sketch)

    n_buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def leads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in chunks_of(batches, "text"):
            _, raw, starts = _joined(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_prefix(raw, np.unique(named_places(raw, starts)[0])))], names=["p"])

    share = min(1.0, SPLITTER_DOCS / max(1, texts.count()))
    drawn = texts.sample(share, seed=1).mapInArrow(leads, "p long").agg(F.percentile_approx(
        "p", [i / n_buckets for i in range(1, n_buckets)], 100_000)).first()[0]
    splitters = np.unique(np.array(drawn or [], np.int64))

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in chunks_of(batches, "text"):
            flat, raw, starts = _joined(own)
            at, first, last, h = named_places(raw, starts)
            spot = (h.astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
            hit = shared.value[spot >> 3] >> (spot & 7) & 1 > 0
            at, first, last = at[hit], first[hit], last[hit]
            text = np.searchsorted(starts, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("_row")).take(pa.array(text)),
                pa.array(np.searchsorted(splitters, _prefix(raw, at), side="right").astype(np.int32)),
                pa.array([flat[a:a + LEAD] for a in at.tolist()], pa.binary()),
                pa.array(at - starts[text]),
                pa.array((at - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                pa.array([flat[a:b] for a, b in zip(first.tolist(), (last + WIN).tolist())], pa.binary()),
            ], names=["_row", "bucket", "lead", "at", "off", "n", "context"])

    dealt = texts.mapInArrow(
        suffixes, "_row long, bucket int, lead binary, at long, off int, n int, context binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "lead").mapInArrow(
        _bucket_spans, "_row long, begin long, end long")


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, number of bytes removed, and of maximal runs of them."""
    kept, at, removed, runs = [], 0, 0, 0
    stop = -1
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or []):
        if begin > stop:
            runs += 1
            kept.append(text[at:begin])
        begin = max(begin, at)
        if end > begin:
            removed += end - begin
            at = stop = end
    return b"".join([*kept, text[at:]]), removed, runs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) of every row.

    Every byte covered by a string of ``WIN`` bytes that also starts elsewhere, in the
    same text or another, is removed; strings are judged on the input. A NULL text
    counts as empty, texts under ``WIN`` bytes stay whole. Ids may be NULL or repeated;
    repeated rows remove each other's bytes. An empty table gives an empty one.
    """
    texts = numbered(df, F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    spans = repeated_spans(texts.select("_row", "text")).groupBy("_row").agg(
        F.collect_set(F.struct("begin", "end")).alias("spans"))
    both = texts.join(spans.hint("shuffle_hash"), "_row", "left").select("id", "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in chunks_of(batches, "text"):
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            kept, removed, runs = zip(*[cut(t, s) for t, s in zip(own, spans)])
            yield out_batch(batch, ["id"], n_bytes=pa.array([len(t) for t in own], pa.int64()),
                            n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()),
                            kept=pa.array(kept, pa.binary()))

    return both.mapInArrow(run, schema_with(
        both, ["id"], "n_bytes long, n_removed long, n_spans long, kept binary"))


def op10_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))
