"""Licence notices in texts: rare words vote for templates by relative position, phrases confirm."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import chunks_of, documents, out_batch, schema_with, words_of
from voxtab.llm.license_texts import BASE_PHRASES, NOTICES

#: Words of each template that the index holds: those of the highest IDF.
RARE_WORDS = 24
#: Share of a template's indexed words that must agree in relative position.
VOTE_SHARE = 0.3
#: Words by which a key phrase may lie outside the aligned template.
SLACK = 8

_SUMMARY = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
            "labels string, score double")


class LicenseIndex:
    """Templates, key phrases, and the places of each template's rarest words."""

    def __init__(self, notices: Sequence[tuple[str, str, list[str]]] = NOTICES,
                 base: Sequence[tuple[str, str]] = BASE_PHRASES):
        self.number: dict[bytes, int] = {}
        ids = lambda text: np.array(
            [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())])
        self.base = [(ids(phrase), label) for phrase, label in base]
        self.labels = [label for label, _, _ in notices]
        self.templates = [ids(text) for _, text, _ in notices]
        self.phrases = [[ids(p) for p in phrases] for _, _, phrases in notices]
        self.posted: list[tuple[np.ndarray, np.ndarray]] = []

    def rank_words(self, found: dict[int, int], n_texts: int) -> None:
        """Take IDF from the number of texts with each word and index the rarest words."""
        idf = np.log((n_texts + 1) / (np.array([found.get(k, 0) for k in range(
            len(self.number) + 1)]) + 1))
        posted: list[list[tuple[int, int]]] = [[] for _ in idf]
        self.voters = []
        for t, template in enumerate(self.templates):
            words = sorted(set(template.tolist()), key=lambda w: (-idf[w], w))[:RARE_WORDS]
            self.voters.append(len(words))
            for w in words:
                posted[w] += [(t, int(p)) for p in np.flatnonzero(template == w)]
        self.posted = [(np.array([t for t, _ in p], np.int64), np.array([x for _, x in p], np.int64))
                       for p in posted]

    def numbers(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))

    @staticmethod
    def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Starts of a phrase."""
        at = np.flatnonzero(ids[:max(0, len(ids) - len(phrase) + 1)] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[ids[at + k] == phrase[k]]
        return at

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """Template, first word and share of the template's words that stand in place.

        Every place of an indexed word is put against its places in the templates;
        those that agree in the difference of the two vote for the same alignment.
        An alignment with votes of enough different words counts if each key phrase
        of the template stands in or next to it.
        """
        known = np.flatnonzero(ids)
        templates, starts, voters = [], [], []
        for w in np.unique(ids[known]).tolist():
            t, p = self.posted[w]
            at = known[ids[known] == w]
            templates.append(np.repeat(t, len(at)))
            starts.append((at - p[:, None]).ravel())
            voters.append(np.full(len(t) * len(at), w))
        if not sum(map(len, templates)):
            return []
        t, s, w = map(np.concatenate, (templates, starts, voters))
        rows = np.unique(np.stack([t, s, w]), axis=1)  # a word votes once for an alignment
        first = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)])
        votes = np.diff(np.r_[first, rows.shape[1]])
        need = np.maximum(1, np.ceil(VOTE_SHARE * np.array(self.voters)))[rows[0, first]]
        out = []
        for t, s in rows[:2, first[votes >= need]].T.tolist():
            template = self.templates[t]
            low, high = max(0, s - SLACK), s + len(template) + SLACK
            near = ids[low:high]
            if all(len(self.places(near, p)) for p in self.phrases[t]):
                own = ids[max(0, s):s + len(template)]
                same = own == template[max(0, -s):max(0, -s) + len(own)]
                out.append((t, s, float(same.mean() if len(own) == len(template)
                                        else same.sum() / len(template))))
        return out

    def scan(self, text: bytes) -> tuple:
        ids = self.numbers(text)
        hits = [(self.places(ids, phrase), label) for phrase, label in self.base]
        starts = np.concatenate([at for at, _ in hits])
        base = {label for at, label in hits if len(at)}
        found = self.matches(ids)
        score = max([share for _, _, share in found] + [0.5 if base else 0.0])
        labels = base | {self.labels[t] for t, _, _ in found}
        return (len(ids), len(starts), int(starts.min()) if len(starts) else None,
                int(starts.max()) if len(starts) else None, ",".join(sorted(base)),
                ",".join(sorted(labels)), score)


def word_counts(df: DataFrame, index: LicenseIndex, text_col: str = "text") -> tuple[dict, int]:
    """Number of texts with each licence word, and number of texts; at most one row a word comes back."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.number) + 1, np.int64), 0
        for _, texts in chunks_of(batches, "text"):
            for text in texts:
                total[np.unique(index.numbers(text))] += 1
            n += len(texts)
        total[0] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy(
        "word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts, counts.pop(0, 0)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  index: LicenseIndex | None = None) -> DataFrame:
    """Per row: ``id``, words, base phrases and their places, labels and score.

    IDF is taken from all rows. score is the share of a notice's words that stand in
    place, at best over the notices found; 0.5 at least if a base phrase stands in
    the text; 0 if nothing was found. A NULL text counts as empty: no words, NULL
    places, empty labels. Ids may be NULL or repeated. An empty table gives an
    empty one.
    """
    index = index or LicenseIndex()
    index.rank_words(*word_counts(df, index, text_col))
    cols = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
             ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
             ("score", pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks_of(batches, "text"):
            found = list(zip(*[index.scan(t) for t in texts]))
            yield out_batch(batch, ["id"], **{
                name: pa.array(values, kind) for (name, kind), values in zip(kinds, found)})

    return cols.mapInArrow(run, schema_with(cols, ["id"], _SUMMARY))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder)).withColumnRenamed("id", "doc_id")
