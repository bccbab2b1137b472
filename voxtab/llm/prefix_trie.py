"""Trie of rebuilt conversations, from fingerprints that are composed and never from rebuilt texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import read_table, written
from voxtab.operators.skew import split_join
from voxtab.sources.catalog import checkpoint

#: A fingerprint of a sequence is its length and, modulo each of four primes, the sum of its turns' numbers times
#: growing powers of a base. Two of them compose without the sequences: (m, a) * (n, b) = (m + n, a + base**m * b).
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Bases; further ones are tried if fingerprints of different sequences should meet.
BASES = ((1103515245, 1664525, 22695477, 214013), (69069, 134775813, 1812433253, 1566083941))
_BITS = 31  # of a prime
#: Heads are shorter than this.
HEAD = 6
#: Conversations that share a base, which is the first of them.
FAMILY = 100
#: Depths, or ids, that are summed up together before whole chains, or lists, are.
BLOCK = 4096

_TURN = ["g1", "g2", "g3", "g4"]  # digest of role and text
_WINDOW = 1 << 16


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int")


def stored_turns(df: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``digest`` (SHA-256 of role and text) and ``n`` (code points of the text) of every stored turn.

    The digest stands for the turn from here on. A NULL role or text is empty; turns
    of no conversation (``conv_id`` NULL) are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("n"))


def _powers(start: np.ndarray, base: int, prime: int) -> np.ndarray:
    """base ** start modulo prime, for an array of exponents."""
    low = np.ones(_WINDOW, np.uint64)
    have = 1
    while have < _WINDOW:  # a table of the first powers, doubled until it is full
        low[have:2 * have] = low[:have] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have *= 2
    high, where = np.unique(start >> 16, return_inverse=True)
    step = np.array([pow(base, int(h) << 16, prime) for h in high], np.uint64)
    return low[start & (_WINDOW - 1)] * step[where] % np.uint64(prime)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The digests as four numbers each."""
    column = batch.column(batch.schema.get_field_index("digest"))
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)


def _products(batches: Iterable[pa.RecordBatch], bases: tuple, conv: int | None, count: int, carry: list[int]
              ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted turns with their place (from 0) and the products before and after them, batch by batch.

    conv, count and carry: the conversation that goes on, its turns so far and their product.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        convs = batch.column(batch.schema.get_field_index("conv")).to_numpy()
        first = np.r_[True, convs[1:] != convs[:-1]]
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        on = conv is not None and convs[0] == conv
        place = np.arange(len(convs)) - starts[group] + np.where(group == 0, count if on else 0, 0)
        numbers = _numbers(batch)
        before, after = np.zeros((4, len(convs)), np.uint64), np.zeros((4, len(convs)), np.uint64)
        for r, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
            p = np.uint64(prime)
            sums = np.r_[np.uint64(0), np.cumsum(numbers[:, r] % p * _powers(place, base, prime) % p)]
            own = np.where(group == 0, np.uint64(carry[r] if on else 0), np.uint64(0))
            before[r] = (sums[:-1] - sums[starts[group]] + own) % p
            after[r] = (sums[1:] - sums[starts[group]] + own) % p
        conv, count, carry = convs[-1], int(place[-1]) + 1, [int(x) for x in after[:, -1]]
        yield batch, place, before, after, numbers


def _pack(residues: np.ndarray) -> list[pa.Array]:
    shift = np.uint64(_BITS)
    return [pa.array(((residues[k] << shift) | residues[k + 1]).astype(np.int64)) for k in (0, 2)]


def prefix_products(turns: DataFrame, bases: tuple = BASES[0]) -> DataFrame:
    """Every stored turn with ``pos`` (from 1) in its conversation and the products before it (``p1``, ``p2``) and with it (``f1``, ``f2``).

    Turns are sorted by ranges of (conversation, turn, digest), NULL turns first, so a
    conversation of any length is spread over tasks; equal turns go by a row number.
    Each range first tells the product of the conversation it ends with. These, one a
    range, are composed on the driver and handed to the ranges as what came before.
    """
    ordered = checkpoint(turns.withColumn("_row", F.monotonically_increasing_id()).orderBy(
        "conv", F.asc_nulls_first("turn"), "digest", "_row").select(
            "conv", "digest", "n", F.spark_partition_id().alias("part")))

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        for batch, place, _, after, _ in _products(batches, bases, None, 0, [0] * 4):
            convs = batch.column(0).to_numpy()
            first = convs[0] if first is None else first
            part = batch.column(3)[0].as_py()
            last = (convs[-1], place[-1] + 1, *after[:, -1])
        if last:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": int(first), "last": int(last[0]), "count": int(
                last[1]), "product": [int(x) for x in last[2:]]}], schema=pa.schema([
                    ("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("count", pa.int64()),
                    ("product", pa.list_(pa.int64()))]))

    told = ordered.mapInArrow(ends, "part long, first long, last long, count long, product array<long>").collect()
    before: dict[int, tuple] = {}
    conv, count, product = None, 0, [0] * 4
    for r in sorted(told, key=lambda r: r.part):
        before[r.part] = (conv, count, product)
        if r.first == r.last == conv:
            product = [(a + pow(b, count, p) * x) % p for a, b, p, x in zip(product, bases, PRIMES, r.product, strict=True)]
            count += r["count"]
        else:
            conv, count, product = r.last, r["count"], list(r.product)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        every = (b for source in ([head], batches) for b in source)
        for batch, place, prior, after, numbers in _products(every, bases, *before[head.column(3)[0].as_py()]):
            turn = numbers.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place + 1), batch.column(2), *_pack(after), *_pack(prior),
                 *[pa.array(turn[:, k]) for k in range(4)]], names=["conv", "pos", "n", "f1", "f2", "p1", "p2", *_TURN])

    return written(ordered.mapInArrow(
        run, "conv long, pos long, n long, f1 long, f2 long, p1 long, p2 long, g1 long, g2 long, g3 long, g4 long"))


def _residues(high: Column, low: Column) -> list[Column]:
    mask = (1 << _BITS) - 1
    return [x for c in (high, low) for x in (F.shiftright(c, _BITS), c.bitwiseAND(mask))]


def _packed(residues: list[Column]) -> list[Column]:
    return [F.shiftleft(residues[k], _BITS).bitwiseOR(residues[k + 1]) for k in (0, 2)]


def rebuilt_prefixes(turns: DataFrame, bases: tuple = BASES[0]) -> DataFrame:
    """A row for every prefix of every rebuilt conversation, the empty one included.

    ``conv``, ``depth``, the fingerprint (``f1``, ``f2``) and that of the prefix one turn
    shorter (``p1``, ``p2``), the last turn's digest (``g1`` to ``g4``) and length (``n``),
    and ``last``, whether it is the whole conversation.

    A conversation's first h turns are replaced by those of its base, with h from
    its id. Its fingerprints are an affine form of its stored products x: with the base's
    product b of m turns and its own o of h turns, b + base**(m - h) * (x - o). So
    each stored turn's product is carried over as it stands.
    """
    firsts = F.array_sort(F.collect_list(F.when(F.col("pos") < HEAD, F.struct(
        "pos", "n", "f1", "f2", "p1", "p2", *_TURN))))  # at most HEAD - 1 of them
    convs = turns.groupBy("conv").agg(F.max("pos").alias("len"), firsts.alias("firsts"))
    convs = written(convs.withColumn("h", head_length(F.col("conv"))).withColumn(
        "base", F.col("conv") - F.col("conv") % FAMILY))
    heads = convs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("firsts").alias("head"))
    known = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce(
        "head", F.slice("firsts", 1, 0)), F.lit(1), F.col("h")))
    m = F.size("head")
    own = F.greatest(F.col("len") - F.col("h"), F.lit(0).cast("long"))
    of_base = [F.coalesce(x, F.lit(0)) for x in _residues(F.get("head", m - 1)["f1"], F.get("head", m - 1)["f2"])]
    skipped = F.get("firsts", F.col("h") - 1)
    of_own = [F.coalesce(x, F.lit(0)) for x in _residues(skipped["f1"], skipped["f2"])]
    factor, shift = [], []
    for r, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
        inverse = F.array(*[F.lit(pow(base, -k, prime)).cast("long") for k in range(HEAD)])
        factor.append(inverse[F.col("h") - m])
        shift.append(F.pmod(of_base[r] - factor[r] * of_own[r] % prime, F.lit(prime)))
    dim = written(known.select(
        "conv", "len", "h", m.alias("m"), "head", own.alias("own"), *[c.alias(f"factor{r}") for r, c in enumerate(factor)],
        *[c.alias(f"shift{r}") for r, c in enumerate(shift)]))
    zero = F.lit(0).cast("long")
    roots = dim.select("conv", zero.alias("depth"), *[zero.alias(c) for c in ("n", "f1", "f2", "p1", "p2", *_TURN)],
                       (F.col("m") + F.col("own") == 0).alias("last"))
    taken = dim.select("conv", "m", "own", F.explode("head").alias("t")).select(
        "conv", F.col("t.pos").alias("depth"), *[f"t.{c}" for c in ("n", "f1", "f2", "p1", "p2", *_TURN)],
        ((F.col("t.pos") == F.col("m")) & (F.col("own") == 0)).alias("last"))
    rest = split_join(turns, dim.drop("head"), ["conv"], "len").where(F.col("pos") > F.col("h"))

    def moved(high: str, low: str) -> list[Column]:
        return _packed([(F.col(f"shift{r}") + F.col(f"factor{r}") * x % p) % p for r, (x, p) in enumerate(
            zip(_residues(F.col(high), F.col(low)), PRIMES, strict=True))])

    (f1, f2), (p1, p2) = moved("f1", "f2"), moved("p1", "p2")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "n", f1.alias("f1"),
                       f2.alias("f2"), p1.alias("p1"), p2.alias("p2"), *_TURN, (F.col("pos") == F.col("len")).alias("last"))
    return written(roots.unionByName(taken).unionByName(rest))


def _nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """Groups of equal fingerprints with ``owner``, their smallest member, and ``n_convs``; whether each is one sequence.

    All members of a group must refer to equal last turns and come from one group one
    turn up; then, from the root down, their sequences are equal.
    """
    checked = [*_TURN, "p1", "p2"]
    same = F.lit(True)
    for c in checked:
        same = same & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    out = written(prefixes.groupBy("depth", "f1", "f2").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in checked for f in (F.min, F.max)]).select(
            "depth", "f1", "f2", "owner", "n_convs", same.alias("same")))
    return out.drop("same"), out.where(~F.col("same")).isEmpty()


def _suffix_sums(chain: DataFrame, values: list[str]) -> DataFrame:
    """The values summed over all greater or equal depths of a conversation, in blocks of depths and over blocks."""
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    cut = chain.withColumn("block", block)
    above = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("conv", "block").agg(*[F.sum(v).alias(v) for v in values]).select(
        "conv", "block", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    each = cut.withColumns({v: F.sum(v).over(inside) for v in values})
    return each.join(totals, ["conv", "block"]).withColumns(
        {v: F.col(v) + F.col(f"_{v}") for v in values}).drop("block", *[f"_{v}" for v in values])


def _end_lists(ends: DataFrame) -> DataFrame:
    """``conv`` and ``depth`` of nodes where members end, and the SHA-256 of these members' ids in order, comma-joined.

    Ids are joined in blocks of numbers; a node's blocks then go through the hash in
    order, one at a time, since SHA-256 has to read them one after the other.
    """
    blocks = ends.groupBy("owner", "depth", F.floor(F.col("conv") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, done = None, None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.string()))], names=["conv", "depth", "ends_sha256"])

        for batch in batches:
            owners, depths, ids = (batch.column(k).to_pylist() for k in range(3))
            for o, d, text in zip(owners, depths, ids, strict=True):
                if node != (o, d):
                    if node:
                        rows.append((*node, done.hexdigest()))
                    node, done = (o, d), hashlib.sha256(text.encode())
                else:
                    done.update(b"," + text.encode())
            yield out()
            rows.clear()
        if node:
            rows.append((*node, done.hexdigest()))
            yield out()

    return blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").select(
        "owner", "depth", "ids").mapInArrow(run, "conv long, depth long, ends_sha256 string")


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations: a row for each node, as the contract of op11 has it.

    df: ``conv_id`` (whole numbers), ``turn``, ``role``, ``text``. A node is a group of prefixes with equal
    fingerprints. Its smallest member owns it. Members of a deeper node are members of
    those above, so a conversation owns its nodes from some depth to its end: chains,
    each hanging from a node of a smaller owner. A node's children are the next of its
    chain and the chains that hang there; its subtree's sums are those of the rest of
    its chain, plus those of the whole chains of its other members.

    NULL roles and texts are empty; a NULL turn comes first; equal turns go by the
    digest of role and text, and repeated rows are turns of their own. Rows without
    conv_id belong to no conversation. Without any conversation there is no root and no
    row. Texts of any length are seen once, for their digest. A conversation may hold
    any share of all turns, and any number may be alike. Further columns are not looked at.
    """
    stored = written(stored_turns(df))
    for bases in BASES:
        prefixes = rebuilt_prefixes(prefix_products(stored, bases), bases)
        nodes, sound = _nodes(prefixes)
        if sound:
            break
    else:
        raise ValueError("Fingerprints of different conversations are equal for all bases")
    members = written(split_join(prefixes.select("conv", "depth", "f1", "f2", "n", "last"), nodes, [
        "depth", "f1", "f2"], "n_convs").drop("f1", "f2"))
    owns = F.col("owner") == F.col("conv")
    saved = (F.col("n_convs") - 1) * F.col("n")
    # start: depth of the first node owned; over: owner of the node above it
    chains = members.groupBy("conv").agg(
        F.min(F.when(owns, F.col("depth"))).alias("start"), F.max(F.when(~owns, F.col("owner"))).alias("over"),
        F.max("depth").alias("end"), F.sum(F.when(owns, saved).otherwise(0)).alias("saved")).where(
            F.col("start").isNotNull())
    chains = written(chains)
    hung = chains.where(F.col("over").isNotNull()).groupBy(
        F.col("over").alias("conv"), (F.col("start") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    leaf = chains.join(hung.withColumnRenamed("depth", "end"), ["conv", "end"], "left").select(
        "conv", "start", "saved", F.col("hung").isNull().cast("long").alias("leaf"))
    others = split_join(members.where(~owns).select("conv", "depth", "owner"), written(leaf.where("start > 0")), [
        "conv"], "start").groupBy(F.col("owner").alias("conv"), "depth").agg(
            F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    none = F.lit(None).cast("long")
    fields = ["n_convs", "own_saved", "next", "hung", "over", "saved", "leaf"]

    def rows(frame: DataFrame, **have: Column) -> DataFrame:
        return frame.select("conv", "depth", *[have.get(c, none).alias(c) for c in fields])

    met = rows(members.where(owns), n_convs=F.col("n_convs"), own_saved=saved, next=(~F.col("last")).cast("long"))
    met = met.unionByName(rows(hung, hung=F.col("hung"))).unionByName(
        rows(others, saved=F.col("saved"), leaf=F.col("leaf"))).unionByName(
            rows(chains.select("conv", F.col("start").alias("depth"), "over"), over=F.col("over")))
    each = met.groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in fields]).withColumn(
        "n_children", F.col("next") + F.coalesce("hung", F.lit(0))).withColumn(
            "own_leaf", (F.col("n_children") == 0).cast("long"))
    each = _suffix_sums(each, ["own_saved", "own_leaf"])
    lists = _end_lists(members.where("last").select("owner", "depth", "conv"))
    return each.join(lists, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("over", "conv")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("own_leaf") + F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(read_table(spark, folder, "conversations"))


#: Sequences as joined digests of turns; every node meets all members of its subtree.
OP11_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
stored AS (SELECT conv_id AS c, length(coalesce(text, '')) AS n, turn,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
    FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, n, g, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM stored),
ids AS (SELECT DISTINCT c, hex(encode(c::VARCHAR)) AS x FROM turns),
convs AS (SELECT c, xor(list_reduce(list_transform(range(length(x) // 2), lambda i:
        ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]),
        4294967295), 4294967295) % 6 AS h FROM ids, steps),
pieces AS (SELECT convs.c, 0 AS part, pos, n, g FROM convs JOIN turns ON turns.c = convs.c - convs.c % 100 AND pos < h
    UNION ALL SELECT convs.c, 1, pos, n, g FROM convs JOIN turns ON turns.c = convs.c AND pos >= h),
numbered AS (SELECT c, n, g, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM pieces),
members AS (SELECT c, depth, n, string_agg(g, '/') OVER (PARTITION BY c ORDER BY depth) AS path FROM numbered
    UNION ALL SELECT c, 0, 0, '' FROM convs),
sizes AS (SELECT c, max(depth) AS size FROM members GROUP BY c),
nodes AS (SELECT path, any_value(depth) AS depth, any_value(n) AS n, min(c) AS conv_id, count(*) AS n_convs,
        string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth) AS ends FROM members JOIN sizes USING (c) GROUP BY path),
up AS (SELECT path, left(path, greatest(length(path) - 65, 0)) AS above FROM nodes WHERE depth > 0),
children AS (SELECT above AS path, count(*) AS n_children FROM up GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, above FROM nodes
    LEFT JOIN children USING (path) LEFT JOIN up USING (path)),
sums AS (SELECT members.path, sum((f.n_convs - 1) * f.n) AS saved, sum((f.n_children = 0)::BIGINT) AS leaves
    FROM members JOIN members low ON low.c = members.c AND low.depth >= members.depth
    JOIN full_nodes f ON f.path = low.path AND f.conv_id = low.c GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
    f.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
    sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN sums USING (path) LEFT JOIN nodes p ON p.path = f.above
"""
