"""Importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import as_column, chunks_of, documents, out_batch, read_table, schema_with, written

BUCKETS = 10_000
#: Least and greatest number of words in a feature.
SIZES = (1, 1)
SEED = 2024
#: Percent of the documents with at least LEAST_WORDS words that are drawn.
PERCENT = 10
LEAST_WORDS = 20

_SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bits of a row's place below its partition's number.
_PLACE_BITS = 33


def ngrams(n: int) -> regex.Pattern:
    """Pattern of n consecutive words of a line whose words are parted by single blanks.

    Scanned with overlaps it starts a match at every word: the lookarounds let a match
    begin and end at the edges of words only.
    """
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def _scan(text: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature."""
    line = _SEPARATORS.sub(b" ", text.lower()).strip(b" ")
    if not line:
        return 0, np.zeros(0, np.int32)
    sums = (crc32(m[0]) for p in patterns for m in p.finditer(line, overlapped=True))
    return line.count(b" ") + 1, (np.fromiter(sums, np.int64) % buckets).astype(np.int32)


def features(df: DataFrame, id_col: Column | str = "doc_id", text_col: str = "text",
             sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """``id``, ``n_words`` and ``buckets``: one bucket for each run of words of the given sizes, repeats included.

    A-Z count as a-z. A bucket is the unsigned CRC-32 of the run's UTF-8 bytes, words
    joined by one blank, modulo ``buckets``. A NULL or wordless text has no features.
    Texts are scanned whole, a few megabytes of them at a time.
    """
    cols = df.select(as_column(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [ngrams(n) for n in range(sizes[0], sizes[1] + 1)]
        for batch, texts in chunks_of(batches, "text"):
            words, found = zip(*[_scan(t, patterns, buckets) for t in texts])
            offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
            yield out_batch(batch, ["id"], n_words=pa.array(words, pa.int64()), buckets=pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate(found))))

    return cols.mapInArrow(run, schema_with(cols, ["id"], "n_words long, buckets array<int>"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each row's begin and end."""
    lists = batch.column(batch.schema.get_field_index("buckets"))
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets - offsets[0]


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: features in each bucket. A task sends one row a bucket at most for each batch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the raw features, smoothed by one.

    Rounded down. The counts of ``buckets`` buckets at most reach the driver, whatever the tables hold.
    """
    s, t = ({r.bucket: r.n for r in bucket_counts(f, buckets).collect()} for f in (raw, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return np.array([floor(1000 * log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t)))
                     for b in range(buckets)], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight``: the mean gain of a row's features, rounded down; 0 without any."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch)
            sums = np.r_[0, np.cumsum(gain[flat])]
            n = np.diff(offsets).astype(np.int64)
            mean = (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(n, 1)
            yield out_batch(batch, ["id", "n_words"], n_features=pa.array(n), weight=pa.array(mean))

    return found.mapInArrow(run, schema_with(found, ["id", "n_words"], "n_features long, weight long"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on the seed and the id alone, rounded down. A NULL id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """Add ``rank`` to the first ``percent`` of the rows with ``able``, by score (high first) and id (NULL last).

    The rows, which are narrow, are sorted by ranges once and written with their
    places; a row's rank is its place plus the number of rows in the ranges before,
    of which there are as many as partitions. Equal rows are dealt on by a row
    number, so one repeated row doesn't fill a range.
    """
    part = F.shiftright("_place", _PLACE_BITS)
    done = written(rows.withColumn("_row", F.monotonically_increasing_id()).orderBy(
        F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), "_row").withColumn(
            "_place", F.monotonically_increasing_id()))
    sizes = done.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able_n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"), (
        F.floor(F.sum("able_n").over(Window.partitionBy()) * percent / 100)).alias("_drawn"))
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    return done.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "rank", F.when(place <= F.col("_drawn"), place)).drop("_part", "_before", "_drawn", "_place", "_row")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; rank is NULL for rows not drawn.

    Rows are drawn without replacement in proportion to the likeness of their features
    to the target's: the highest ``percent`` of weight plus Gumbel noise. Only rows of
    at least ``least_words`` words can be drawn. Each text is scanned once; its
    buckets are written, then counted, then weighed.

    NULL and empty texts have no features, weight 0 and no rank. Ids may be NULL (last
    among equal scores) or repeated; repeated rows each have a rank. An empty target
    has the smoothed even distribution; an empty table gives an empty one. Further
    columns are not looked at.
    """
    found = written(features(df, id_col, text_col, sizes, buckets))
    gain = gains(found, features(target, F.lit(0), target_text, sizes, buckets), buckets)
    rows = weights(found, gain).select(
        "id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"),
        (F.col("n_words") >= least_words).alias("able"))
    return ranked(rows, percent).drop("able")


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return resample(documents(spark, folder), read_table(spark, folder, "benchmark")).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of a word by a table over bytes; everything else as stated in ``resample``.
OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
words AS (SELECT 0 AS side, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hexed AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM words),
crc AS (SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i:
        ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]),
        4294967295), 4294967295) % 10000 AS bucket FROM hexed, steps),
placed AS (SELECT side, doc_id, bucket FROM words JOIN crc USING (word)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT
        AS gain FROM counts, totals),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM placed JOIN gained USING (bucket)
        WHERE side = 0 GROUP BY doc_id),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features,
        coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
        ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight,
        weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed_rows AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
        10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
    CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN placed_rows USING (doc_id)
"""
