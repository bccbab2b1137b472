"""Language of a text by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import as_column, chunks_of, documents, out_batch, schema_with
from voxtab.operators.skew import top_k

NGRAM_SIZES = (1, 2, 3)
PROFILE_SIZE = 400
#: Labelled texts per language from which a profile is learned, at most.
SAMPLE_DOCS = 600
#: Characters of a text counted at once.
SPAN = 1 << 20
UNKNOWN = "und"

_BITS = 21  # of a code point


class Letters:
    """For every code point its lower case, or 0 if it is no letter. Made once per process."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            lower = np.zeros(0x110000, np.uint32)
            for c in range(0x110000):
                ch = chr(c)
                if ch.isalpha():
                    small = ch.lower()
                    lower[c] = ord(small) if len(small) == 1 else c
            cls._table = lower
        return cls._table


def ranked_ngrams(text: bytes, sizes: tuple[int, ...] = NGRAM_SIZES,
                  keep: int = PROFILE_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` most frequent n-grams of the letter runs of a text, and how often each stands.

    Runs are lower-cased and closed by a blank on both sides; the lone blank is not
    counted. An n-gram is its code points packed into one number. Ties go to the
    smaller number.
    """
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letters = Letters.table()[points].astype(np.uint64)
    if not letters.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = letters == 0
    letters = np.r_[letters[~(gap & np.r_[True, gap[:-1]])], np.uint64(0)]
    letters = np.r_[np.uint64(0), letters[:-1] if letters[-2] == 0 else letters]
    letters[letters == 0] = 32
    grams, counts = [], []
    for start in range(0, len(letters), SPAN):
        piece = letters[start:start + SPAN + max(sizes) - 1]
        packed, found = piece, []
        for n in range(1, max(sizes) + 1):
            if n > 1:
                packed = (packed[:len(piece) - n + 1] << np.uint64(_BITS)) | piece[n - 1:]
            if n in sizes:
                found.append(packed[:SPAN])
        every = np.concatenate(found)
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        grams.append(every[first])
        counts.append(np.diff(np.r_[first, len(every)]))
    gram, count = grams[0], counts[0]
    if len(grams) > 1:
        gram, where = np.unique(np.concatenate(grams), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
    lone = gram != 32
    gram, count = gram[lone], count[lone]
    if len(gram) > keep:
        bar = np.partition(count, len(count) - keep)[len(count) - keep]
        some = count >= bar
        gram, count = gram[some], count[some]
    order = np.lexsort([gram, -count])[:keep]
    return gram[order], count[order]


class Profiles:
    """Language profiles and the out-of-place distance to each of them."""

    def __init__(self, ranked: dict[str, np.ndarray], keep: int = PROFILE_SIZE):
        self.names, self.keep = sorted(ranked), keep
        every = [ranked[n] for n in self.names]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]))
        self.place = np.full((len(self.grams), len(self.names)), -1, np.int64)
        for k, grams in enumerate(every):
            self.place[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def guess(self, text: bytes) -> tuple[str, float, float]:
        """Language, score, and likeness of the nearest profile.

        Each n-gram of the text is as far out of place as its rank differs from its
        rank in the profile, or ``keep`` if it is not there. likeness is 1 for the
        same order and 0 if no n-gram is shared. score puts likenesses in proportion
        (to the 8th power) over all languages. A text without a letter is unknown,
        with score 0; so is every text if no language was learned.
        """
        gram, _ = ranked_ngrams(text, keep=self.keep)
        if not len(gram) or not len(self.grams):
            return UNKNOWN, 0.0, 0.0
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        place = np.where((self.grams[at] == gram)[:, None], self.place[at], -1)
        off = np.abs(place - np.arange(len(gram))[:, None])
        off = np.where(place < 0, self.keep, np.minimum(off, self.keep))
        like = 1 - off.sum(0) / (self.keep * len(gram))
        best = int(np.argmax(like))
        weight = (like + 1e-9) ** 8
        return self.names[best], float(weight[best] / weight.sum()), float(like[best])


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE_DOCS, keep: int = PROFILE_SIZE) -> Profiles:
    """Profiles from labelled rows; rows without text or language teach nothing.

    At most ``sample`` texts a language are used, those whose id and text hash
    lowest, and of each its whole text. Every task counts the n-grams of a text;
    the counts of a language are added up in Spark as shares of the text, so that
    one long text doesn't outweigh all others.
    """
    cols = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                     F.xxhash64(F.col(id_col), F.lit(7)).alias("key"))
    rows = cols.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    some = top_k(rows, sample, [F.col("key"), F.col("text")], ["lang"]).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks_of(batches, "text"):
            found = [ranked_ngrams(t, keep=4 * keep) for t in texts]
            sizes = [len(g) for g, _ in found]
            share = [np.round(c * (1e9 / max(1, c.sum()))).astype(np.int64) for _, c in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(texts)), sizes))),
                pa.array(np.concatenate([g for g, _ in found]).view(np.int64)),
                pa.array(np.concatenate(share))], names=["lang", "gram", "n"])

    counted = some.mapInArrow(count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    best = top_k(counted, keep, [F.desc("n"), F.col("gram")], ["lang"])
    ranked: dict[str, list] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.rank)):
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles({k: np.array(v, np.int64).view(np.uint64) for k, v in ranked.items()}, keep)


def identify(df: DataFrame, profiles: Profiles, id_col: Column | str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``likeness`` of every row, from its text alone.

    NULL, empty and letterless texts are ``und`` with score 0. Ids may be NULL or
    repeated; an empty table gives an empty one.
    """
    cols = df.select(as_column(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks_of(batches, "text"):
            lang, score, like = zip(*[profiles.guess(t) for t in texts])
            yield out_batch(batch, ["id"], lang_pred=pa.array(lang, pa.string()),
                            score=pa.array(score, pa.float64()), likeness=pa.array(like, pa.float64()))

    return cols.mapInArrow(run, schema_with(
        cols, ["id"], "lang_pred string, score double, likeness double"))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves that remainder; False for a NULL id."""
    left = F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
    return F.coalesce(left == part, F.lit(False))


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    profiles = learn(docs.where(~held_out("doc_id", 3, 1)))
    return identify(docs, profiles).select(
        F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"),
        "lang_pred", "score", "likeness")
