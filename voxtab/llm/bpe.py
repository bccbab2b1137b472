"""Byte-level BPE: words are split by a pattern, merged by rank with higher-order functions, and decoded."""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from voxtab.functions.values import let
from voxtab.llm.common import bound_batches, documents, out_batch, written

#: Longer words (in bytes) are merged with a heap, since a fold over n bytes takes n * n steps.
FOLD_BYTES = 48
#: Frequent words are encoded once and sent to every task; all other words are encoded
#: where they occur. Bounds on their number and on their length in bytes bound their size
#: (64 MB at most, about 20 MB with words of usual length). No result depends on them.
HOT_WORDS = 1 << 20
HOT_BYTES = 32
HOT_COUNT = 3
#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 4 << 20
NO_RANK = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The splitting pattern with white space spelt out as Unicode defines it."""
    space = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(
        r"\s", f"[{space}]")


class Merges:
    """The rank map over pairs of tokens, laid out for one probe per pair.

    ``slots`` holds left * 2^32 + right * 2^16 + merged; a pair's slot is its second
    hash plus the shift that its first hash names, chosen so that no two pairs share one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) > NO_RANK - 1 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("Ranks need all single bytes and fewer than 65,535 tokens")
        self.single = [ranks[bytes([b])] for b in range(256)]
        pairs = [(ranks[t[:i]] << 16 | ranks[t[i:]], r) for t, r in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.bits = max(4, (2 * len(pairs)).bit_length())
        keys = np.array([k for k, _ in pairs], np.int64)
        self.factor = 1181783497
        while len(np.unique(self._slot_at(keys) << 32 | self._shift_at(keys))) < len(keys):
            self.factor += 2  # pairs that agree in both hashes could never be told apart
        groups: dict[int, list[tuple[int, int]]] = {}
        for shift_at, slot, (key, r) in zip(
                self._shift_at(keys).tolist(), self._slot_at(keys).tolist(), pairs):
            groups.setdefault(shift_at, []).append((slot, key << 16 | r))
        size = 1 << self.bits
        self.slots, self.shifts = [-1] * size, [0] * (1 << self.bits - 3)
        for at, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            shift = next(x for x in range(size) if all(
                self.slots[(s + x) % size] < 0 for s, _ in own))
            self.shifts[at] = shift
            for s, packed in own:
                self.slots[(s + shift) % size] = packed

    def columns(self) -> tuple[Column, Column]:
        """The literal rank map: slots and shifts as two constants of the plan.

        They are a one-row table of a few MB in the shared folder, read as scalars. Arrays
        written into the plan itself would be spelt out in every text of the plan that
        the driver makes, several times a stage.
        """
        spark = SparkSession.getActiveSession()
        lists = [pa.array([self.slots], pa.list_(pa.int64())), pa.array([self.shifts], pa.list_(pa.int32()))]
        table = written(spark.createDataFrame(pa.table(lists, names=["slots", "shifts"])))
        return table.select("slots").scalar(), table.select("shifts").scalar()

    def _shift_at(self, key: np.ndarray) -> np.ndarray:
        return (key * 1640531527 >> 27) & ((1 << self.bits - 3) - 1)

    def _slot_at(self, key: np.ndarray) -> np.ndarray:
        return (key * self.factor >> 25) & ((1 << self.bits) - 1)


def with_map(df: DataFrame, merges: Merges, name: str, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Set a column to a value made from the rank map's slots and shifts, each bound once per row.

    The optimizer takes the two scalars into the value, so rows don't carry them.
    """
    slots, shifts = merges.columns()
    made = let(F.col("_slots"), lambda a: let(F.col("_shifts"), lambda b: value(a, b)))
    return df.select("*", slots.alias("_slots"), shifts.alias("_shifts")).withColumn(name, made).drop("_slots", "_shifts")


def folded(word: Column, merges: Merges, slots: Column, shifts: Column) -> Column:
    """Token ids of a word given as the ids of its bytes (an array of ints).

    The leftmost pair of lowest rank is merged, again and again. The state of the
    fold is the token ids, the rank of every neighbouring pair, the lowest of these
    and its place; a merge looks up two new pairs only. NULL gives NULL, no bytes
    give no ids. slots, shifts: the rank map, see ``with_map``.
    """
    low_bits, slot_bits = (1 << merges.bits - 3) - 1, (1 << merges.bits) - 1

    def joined(*parts):
        return F.flatten(F.array(*parts))

    def rank(a, b):
        return let(F.shiftleft(a.cast("bigint"), 16).bitwiseOR(b), lambda key: let(
            F.get(slots, (F.shiftright(key * merges.factor, 25) + F.get(shifts, F.shiftright(
                key * 1640531527, 27).bitwiseAND(low_bits).cast("int"))).bitwiseAND(slot_bits).cast("int")),
            lambda h: F.when(F.shiftright(h, 16) == key, h.bitwiseAND(65535).cast("int"))
            .otherwise(NO_RANK)))

    def state(ids, ranks):
        return let(ranks, lambda r: let(F.array_min(r), lambda m: F.struct(
            ids.alias("ids"), r.alias("ranks"), m.alias("low"),
            F.array_position(r, m).cast("int").alias("at"))))

    def merge(s):
        at, low, n = s["at"], s["low"], F.size(s["ids"])
        ids = joined(F.slice(s["ids"], F.lit(1), at - 1), F.array(low), F.slice(s["ids"], at + 2, n))
        left = F.when(at > 1, F.array(rank(F.get(s["ids"], at - 2), low))).otherwise(none)
        right = F.when(at + 1 < n, F.array(rank(low, F.get(s["ids"], at + 1)))).otherwise(none)
        ranks = joined(F.slice(s["ranks"], F.lit(1), F.greatest(at - 2, F.lit(0))), left, right,
                       F.slice(s["ranks"], at + 2, n))
        return state(ids, ranks)

    none = F.array().cast("array<int>")

    def fold(w):
        first = state(w, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)),
                                    lambda a, b: rank(a, b)))
        return F.aggregate(w, first, lambda s, _: F.when(s["low"] < NO_RANK, merge(s)).otherwise(s),
                           lambda s: s["ids"])

    return F.when(F.size(word) > 1, let(word, fold)).otherwise(word)


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of any length, in n log n steps."""
    piece = [word[i:i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and (j := after[i]) < len(word):
            both = piece[i] + piece[j]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, len(both)))

    for i in range(len(word)):
        push(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not piece[i] or (j := after[i]) >= len(word) or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        after[i] = after[j]
        if after[j] < len(word):
            before[after[j]] = i
        push(before[i])
        push(i)
    return [ranks[p] for p in piece if p]


class Vocabulary:
    """Ranks, their merge tables, and the pieces of the tokens by id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.merges = ranks, java_pattern(pattern), Merges(ranks)
        self.single = np.array(self.merges.single, np.int32)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, r in ranks.items():
            self.pieces[r] = piece

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))


def byte_ids(words: pa.Array, single: np.ndarray) -> pa.Array:
    """Of string words, the ids of their bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(single[raw], pa.int32()))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """Bytes of an array of token ids: the pieces of the tokens, one after the other."""
    hexes = F.split(F.lit(",".join(p.hex() for p in vocabulary.pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), ""))


def hot_words(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text",
              most: int = HOT_WORDS) -> pa.Table:
    """``word`` and ``ids`` of frequent words, at most ``most`` of them.

    Words are counted over all texts. Counts fall into classes (an eighth of a
    doubling wide); whole classes are taken from the top as long as they fit.
    """
    words = df.select(F.explode(vocabulary.words(F.col(text_col))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n")).where(
        (F.col("n") >= HOT_COUNT) & (F.octet_length("word") <= HOT_BYTES))
    often = written(often.withColumn("class", F.floor(F.log2("n") * 8).cast("int")))
    least, left = math.inf, most
    for r in sorted(often.groupBy("class").count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["class"]

    single = vocabulary.single

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out_batch(batch, ["word"], bytes=byte_ids(batch.column(0), single))

    hot = often.where(F.col("class") >= (least if least < math.inf else 1 << 30)).select("word")
    return with_map(hot.mapInArrow(start, "word string, bytes array<int>"), vocabulary.merges, "ids",
                    lambda slots, shifts: folded(F.col("bytes"), vocabulary.merges, slots, shifts)).select(
        "word", "ids").toArrow()


class Known:
    """Words with their token ids, found by a sorted hash so that lookups build no index."""

    def __init__(self, table: pa.Table):
        self.words, self.ids = (table.column(n).combine_chunks() for n in ("word", "ids"))
        step = 1 << 16
        keys = np.concatenate([np.zeros(0, np.uint64), *(
            self._keys(self.words.slice(i, step)) for i in range(0, len(self.words), step))])
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    @staticmethod
    def _keys(words: pa.Array) -> np.ndarray:
        return np.fromiter(map(xxh64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word stands, -1 if it isn't there. Of known words with one hash, the first is found."""
        out = np.full(len(words), -1, np.int32)
        if len(self.keys):
            own = self._keys(words)
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == own)
            place = self.order[at[hit]]
            same = pc.equal(self.words.take(pa.array(place)), words.take(pa.array(hit)))
            out[hit] = np.where(same.to_numpy(zero_copy_only=False), place, -1)
        return out


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list array."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), sizes


def encoded(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
            hot: int = HOT_WORDS) -> DataFrame:
    """``id``, ``ids`` (array of ints) of every row; see ``digests`` for the parameters' meaning."""
    def finish(tokens: list[np.ndarray]) -> dict:
        sizes = np.cumsum([0, *map(len, tokens)])
        return {"ids": pa.ListArray.from_arrays(
            pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *tokens])))}

    return _encode(df, vocabulary, id_col, text_col, hot, finish, "ids array<int>")


def digests(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
            hot: int = HOT_WORDS) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    ids_sha256 is over the decimal ids joined by blanks, decoded_sha256 over the
    bytes that the ids decode to. A NULL text counts as empty: no tokens. Ids may
    be NULL or repeated. An empty table gives an empty one. A text of any length is
    split and encoded whole. ``hot`` bounds the words that are encoded beforehand.
    """
    decimal = [b"%d" % i for i in range(len(vocabulary.pieces))]
    pieces = vocabulary.pieces

    def finish(tokens: list[np.ndarray]) -> dict:
        ids, back = [], []
        for t in map(np.ndarray.tolist, tokens):  # one text's numbers at a time
            ids.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, t))).hexdigest())
            back.append(hashlib.sha256(b"".join(map(pieces.__getitem__, t))).hexdigest())
        return {"n_tokens": np.array([len(t) for t in tokens], np.int64), "ids_sha256": ids, "decoded_sha256": back}

    return _encode(df, vocabulary, id_col, text_col, hot, finish,
                   "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(df, vocabulary, id_col, text_col, hot, finish, out):
    """Look words up, fold those that are not there, put the ids of each text together.

    The three steps run in one stage. Between them a row stands for a chunk of
    texts: the number of words of each text, the word numbers, and per distinct
    word its ids or its bytes.
    """
    bound_batches(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(Known(hot_words(df, vocabulary, text_col, hot)))
    cols = df.select(F.col(id_col).alias("id"), vocabulary.words(F.col(text_col)).alias("words"))
    kind = cols.schema["id"].dataType.simpleString()
    ranks, single = vocabulary.ranks, vocabulary.single

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _word_chunks(batches):
            words = batch.column(1)
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary
            place = known.value.places(distinct)
            size = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
            # 0: known, 1: merged here, 2: folded in the next step
            at = np.where(place >= 0, 0, np.where(size > FOLD_BYTES, 1, 2)).astype(np.int8)
            long = [merged_by_heap(w.encode(), ranks)
                    for w in distinct.filter(pa.array(at == 1)).to_pylist()]
            values, lengths = zip(_flat(known.value.ids.take(pa.array(place[place >= 0]))),
                                  _flat(pa.array(long, pa.list_(pa.int32()))))
            cold = byte_ids(distinct.filter(pa.array(at == 2)), single)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0)),
                pa.array([np.diff(words.offsets.to_numpy()).astype(np.int32).tobytes()], pa.binary()),
                pa.array([coded.indices.to_numpy().astype(np.int32).tobytes()], pa.binary()),
                pa.array([at.tobytes()], pa.binary()),
                pa.array([np.concatenate(values).astype(np.int32).tobytes()], pa.binary()),
                pa.array([np.concatenate(lengths).astype(np.int32).tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(cold)], pa.int32()), cold),
            ], names=["id", "sizes", "codes", "at", "made", "lengths", "cold"])

    def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                row = {n: rows.column(k)[i] for k, n in enumerate(rows.schema.names)}
                sizes, codes, made, lengths = (
                    np.frombuffer(row[n].as_buffer(), np.int32) for n in ("sizes", "codes", "made", "lengths"))
                at = np.frombuffer(row["at"].as_buffer(), np.int8)
                folds, more = _flat(row["cold"].values)
                values, lengths = np.concatenate([made, folds]), np.concatenate([lengths, more]).astype(np.int64)
                begins = np.cumsum(lengths) - lengths
                entry = np.empty(len(at), np.int64)  # by kind, in the order of the kinds' lists
                entry[np.argsort(at, kind="stable")] = np.arange(len(at))
                entry = entry[codes]
                n = lengths[entry]
                ends = np.cumsum(n)
                tokens = values[np.arange(n.sum()) + np.repeat(begins[entry] - ends + n, n)]
                stops = np.concatenate([[0], ends])[np.cumsum(sizes)]
                made = finish(np.split(tokens, stops[:-1]))
                made = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()}
                yield pa.RecordBatch.from_arrays(
                    [row["id"].values, *made.values()], names=["id", *made])

    chunks = cols.mapInArrow(look_up, f"id array<{kind}>, sizes binary, codes binary, at binary, "
                                      "made binary, lengths binary, cold array<array<int>>")
    done = with_map(chunks, vocabulary.merges, "cold", lambda slots, shifts: F.transform(
        "cold", lambda w: folded(w, vocabulary.merges, slots, shifts)))
    return done.mapInArrow(put_together, f"id {kind}, {out}")


def _word_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHUNK_BYTES`` of words; a longer text is taken alone."""
    for batch in batches:
        words = batch.column(1)
        strings = words.values
        at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:] if len(strings) else [0]
        ends = np.asarray(at)[words.offsets.to_numpy()]
        start = 0
        while start < len(batch):
            stop = int(np.searchsorted(ends, ends[start] + CHUNK_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), len(batch))
            yield batch.slice(start, stop - start)
            start = stop


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(documents(spark, folder), default_vocabulary()).withColumnRenamed("id", "doc_id")


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return Vocabulary(ranks, public_tokenizers.PATTERN)
