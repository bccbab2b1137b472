"""Spot signatures: chains of content words that follow common words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.functions.values import let
from voxtab.llm.common import ascii_lower, documents

#: Common words of English, French, German and Spanish. So are all words
#: of up to SHORT_WORD letters.
COMMON = """
about after also been before between could first from have into like made many more most only other over
should some such than that their them then there these they this through under very were what when where
which while will with would your
alors avec cette comme dans elle elles entre être leur leurs mais même nous notre pour plus quand sans sont
sous tout tous très votre vous
aber alle auch auf beim dann dass dein denn dies diese durch eine einem einen einer eines haben hatte ihre
kein mehr mein nach nicht noch oder ohne sehr sein seine sich sind über unter vom wenn werden wird wurde
zwischen
aunque bien como cuando donde desde ellos entre ella esta este estas estos hasta había hacia más muy nada
nosotros otra otro para pero porque según sido sobre también tiene todo todos unas unos
""".split()
SHORT_WORD = 3
#: Content words in a chain, and how many words after the anchor it may take to find them.
CHAIN = 2
REACH = 6
#: Likeness below which two sets are told apart by their sizes alone.
LEAST = 0.02


def _common(word: Column) -> Column:
    return (F.length(word) <= SHORT_WORD) | word.isin(COMMON)


def signatures(text: Column) -> Column:
    """The set of spot signatures of a text, as a sorted array of ints.

    Every common word is an anchor; its signature is a hash of it and the next
    ``CHAIN`` words that are not common. Anchors with fewer such words within
    ``REACH`` have none. The beginning of the text is an anchor too, followed by the
    first words whatever they are, so a text with a word has a signature. NULL and
    texts without words have none.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))),
                             r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")

    def spot(w: Column, word: Column, i: Column) -> Column:
        chain = F.filter(F.slice(w, i + 2, REACH), lambda c: ~_common(c))
        return let(chain, lambda c: F.when(F.size(c) >= CHAIN, F.hash(
            word, *[F.get(c, F.lit(k)) for k in range(CHAIN)])))

    def spots(w: Column) -> Column:
        inner = F.transform(w, lambda word, i: F.when(_common(word), spot(w, word, i)))
        start = F.when(F.size(w) > 0, F.hash(F.lit("^"), *[F.get(w, F.lit(k)) for k in range(CHAIN)]))
        return F.sort_array(F.array_distinct(F.array_compact(F.concat(inner, F.array(start)))))

    return let(words, spots)


def as_string(spots: Column) -> Column:
    """The set as text: 8 hexadecimal digits for each signature."""
    return F.lower(F.array_join(F.transform(
        spots, lambda s: F.substring(F.hex(s.cast("long") + (1 << 32)), -8, 8)), ""))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard likeness of two signature sets; 0 where it is sure to be below ``least``.

    Sets of m and n signatures are at most min(m, n) / max(m, n) alike, so the sizes
    alone prune; only the rest are intersected. Two empty sets are alike.
    """
    m, n = F.size(a), F.size(b)
    low, high = F.least(m, n), F.greatest(m, n)
    both = F.size(F.array_intersect(a, b))
    return F.when(high == 0, 1.0).when(low < high * least, 0.0).otherwise(
        let(both, lambda k: k / (m + n - k)))


def length_class(size: Column, least: float) -> Column:
    """Class of a set's size: sets that can be ``least`` alike are in the same or the next class."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)))).otherwise(-1)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: float = 0.8) -> DataFrame:
    """``a``, ``b``, ``likeness``: pairs of different signature sets at least ``least`` alike.

    a and b are the smallest ids of their sets; rows with equal sets are one class
    and are not paired. Sets are partitioned by length class; within a class and
    with the one above, two sets that are alike share one of their first signatures
    in the order of rarity (all but the ``least`` share of them, plus one), which is
    what they are joined on; then sizes prune and the rest are intersected.
    """
    sets = df.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("s")).groupBy("s").agg(
        F.min("id").alias("id")).where(F.size("s") > 0)
    rare = sets.select("id", F.explode("s").alias("sig")).withColumn(
        "n", F.count("*").over(Window.partitionBy("sig")))
    ranked = rare.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("r")).join(sets, "id")
    size = F.size("s")
    keep = size - F.ceil(size * least).cast("int") + 1
    probe = ranked.select("id", "s", length_class(size, least).alias("class"), F.explode(
        F.transform(F.slice("r", F.lit(1), keep), lambda x: x["sig"])).alias("sig"))
    other = probe.select(F.col("id").alias("b"), F.col("s").alias("t"), "sig", F.explode(
        F.array(F.col("class"), F.col("class") - 1)).alias("class"))
    pairs = probe.withColumnRenamed("id", "a").join(other, ["class", "sig"])
    can = F.least(F.size("s"), F.size("t")) >= F.greatest(F.size("s"), F.size("t")) * least
    pairs = pairs.where((F.col("a") != F.col("b")) & can).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        likeness(F.col("s"), F.col("t")).alias("likeness"))
    return pairs.where(F.col("likeness") >= least).distinct()


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rows_per_bucket: int = 2000, most: int = 2000) -> DataFrame:
    """``id``, ``text`` and ``next``: the text of the next row by id, of the first for the last.

    Rows are dealt into ranges of ids by quantiles; each range also gets the first
    text of the range after it, so a window within the range finds every next text
    and texts are shuffled once. NULL ids come last, in the order of a hash of their
    texts; equal ids go by text. A NULL text is empty.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n, ids = rows.agg(F.count("*"), F.count("id")).first()
    parts = max(1, min(most, n // rows_per_bucket))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 100_000)
                    ).first()[0] if ids else None
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    key = F.xxhash64("text")
    bucket = F.when(F.col("id").isNull(), len(cuts) + 1 + F.floor(
        (F.shiftrightunsigned(key, 1) / float(1 << 63)) * parts).cast("int")).otherwise(
            F.size(F.filter(bounds, lambda b: b <= F.col("id"))))
    order = F.when(F.col("id").isNull(), F.shiftrightunsigned(key, 1)).otherwise(F.col("id"))
    rows = rows.withColumn("bucket", bucket).withColumn("order", order)
    first = rows.groupBy("bucket").agg(F.min("order").alias("order"))
    heads = rows.join(F.broadcast(first), ["bucket", "order"]).groupBy("bucket").agg(
        F.min("text").alias("text"))  # at most 2 * parts rows in all
    known = sorted(r.bucket for r in first.collect())
    before = dict(zip(known, [*known[-1:], *known[:-1]]))
    moved = F.array(*[F.lit(before.get(b, 0)) for b in range(max(known, default=0) + 1)])
    ghosts = heads.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text",
                          moved[F.col("bucket")].alias("bucket"), F.lit(None).cast("long").alias("order"),
                          F.lit(True).alias("ghost"))
    every = rows.withColumn("order", F.col("order").cast("long")).withColumn(
        "ghost", F.lit(False)).unionByName(ghosts)
    ahead = F.lead("text").over(Window.partitionBy("bucket").orderBy("ghost", "order", "text"))
    return every.withColumn("next", ahead).where(~F.col("ghost")).select("id", "text", "next")


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.col("next"), F.lit(1), half))
    rows = with_next(df, id_col, text_col).withColumn("edited", edited)
    rows = rows.select(
        "id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(F.struct(signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("edited"),
                         signatures(F.col("next")).alias("next"))).alias("s"))
    made = F.transform("s", lambda s: F.struct(
        as_string(s["own"]).alias("fingerprint"), as_string(s["edited"]).alias("edited_fingerprint"),
        likeness(s["own"], s["edited"]).alias("near_edited"),
        likeness(s["own"], s["next"]).alias("near_next")))
    return rows.select("id", "n_chars", "edited_sha256", F.inline(made))


def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edits(documents(spark, folder)).withColumnRenamed("id", "doc_id")
