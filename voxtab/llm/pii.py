"""Personal data in texts: fixed kinds, and further identifiers found by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.functions.values import let
from voxtab.llm.common import ascii_lower, documents, numbered, written
from voxtab.operators.skew import split_join

#: Kinds in the order in which spans are listed. Each pattern finds the same matches as its plain form, but
#: starts only where a run of its characters (or the search) starts, so long runs aren't gone through again and
#: again, and cards of a wrong number of digits are no match to begin with.
BASE_KINDS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: Words with at least four digits may be identifiers of some kind.
CANDIDATE = (r"(?<![A-Za-z0-9._/#@+-])(?=(?:[A-Za-z._/#@-]{0,20}+[0-9]){4})"
             r"[A-Za-z0-9][A-Za-z0-9._/#@-]{4,62}[A-Za-z0-9](?![A-Za-z0-9_/#@-])")
KINDS = [name for name, _ in BASE_KINDS]
N_BASE = len(KINDS)
#: Names of spans: base kinds, then those found by context.
NAMES = [*KINDS, *[f"context_{k}" for k in KINDS]]

#: Different identifiers of one kind that a pattern must have met, and their least share, in thousandths, of all it met.
SUPPORT = 3
CONFIDENCE = 800
#: How often identifiers found so far are used to look for further patterns.
ROUNDS = 2
#: Code points before and after an identifier from which its patterns are taken.
REACH = 48

_MARK = "\x01"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PART = "array<struct<kind:int,gap:int,size:int,ok:boolean,value:binary,patterns:array<string>>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    def add(total: Column, c: Column) -> Column:
        twice = 2 * c["d"] - F.when(c["d"] > 4, 9).otherwise(0)
        return total + F.when(c["odd"], twice).otherwise(c["d"])

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(chars, lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2 == 1).alias("odd")))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return {
        "ip": match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": _luhn(digits),
        "phone": F.length(digits).between(8, 15),
    }.get(KINDS[kind] if kind < N_BASE else "", F.lit(True))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of an identifier between two texts: two words before; a word on both sides; a word and its sign before."""
    near = F.substring(before, -REACH, REACH)
    sign = F.regexp_extract(ascii_lower(near), r"""([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)\s*[:=#]\s*["']?$""", 1)

    def made(left: Column, right: Column) -> Column:
        last = F.get(left, F.size(left) - 1)
        return F.array_distinct(F.array_compact(F.array(
            F.concat(F.get(left, F.size(left) - 2), F.lit(" "), last, F.lit(" _")),
            F.concat(last, F.lit(" _ "), F.get(right, F.lit(0))),
            F.when(sign != "", F.concat(sign, F.lit(": _"))))))

    return let(_words(near), lambda left: let(
        _words(F.substring(after, 1, REACH)), lambda right: made(left, right)))


def _scan(text: Column, kind: int) -> Column:
    """Matches of one kind in order, each with the length of the gap before it.

    The text is gone through once: matches are put between marks, at which it is cut.
    """
    pattern = BASE_KINDS[kind][1] if kind < N_BASE else CANDIDATE
    plain = F.translate(text, _MARK, "\x02")  # the mark itself is in no kind
    pieces = F.split(F.regexp_replace(plain, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def part(p: Column, i: Column) -> Column:
        before, match, after = F.get(p, 2 * i), F.get(p, 2 * i + 1), F.get(p, 2 * i + 2)
        return F.struct(
            F.lit(kind).alias("kind"), F.length(before).alias("gap"), F.length(match).alias("size"),
            _valid(kind, match).alias("ok"), F.unhex(F.md5(F.lower(match).cast("binary"))).alias("value"),
            _patterns(before, after).alias("patterns"))

    return let(pieces, lambda p: F.when(F.size(p) > 1, F.transform(
        F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda i: part(p, i))).otherwise(
            F.array().cast(_PART)))


def identifiers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (``_row``, ``id``), and the base spans and candidates in them.

    The latter have ``_row``, ``kind`` (a number into KINDS, N_BASE for candidates),
    ``start`` and ``end`` (code points, the end exclusive), ``value`` (digest of the
    lower-cased match) and ``patterns``. Candidates that overlap a base span are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.concat(*[F.when(text.contains("@"), _scan(text, k)).otherwise(F.array().cast(_PART))
                       if k == 0 else _scan(text, k) for k in range(N_BASE + 1)])
    rows = numbered(df, F.col(id_col).alias("id"), parts.alias("parts"))
    flat = rows.where(F.size("parts") > 0).select("_row", F.posexplode("parts").alias("n", "p")).select(
        "_row", "n", "p.*").repartition("_row")
    upto = Window.partitionBy("_row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok").select(
        "_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", "patterns")
    along = Window.partitionBy("_row").orderBy("start", "kind")
    base = F.col("kind") < N_BASE
    before = F.max(F.when(base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = found.select("*", before.alias("before"), after.alias("after"))
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return rows.select("_row", "id"), written(marked.where(base | free).drop("before", "after"))


def _confident(votes: DataFrame) -> DataFrame:
    """``pattern``, ``kind``, ``confidence``: patterns that meet mostly identifiers of one kind.

    votes: ``pattern``, ``met`` (different identifiers that it meets), ``kind`` and
    ``belief`` of one of them. As each identifier votes for one kind, a pattern has one.
    """
    score = votes.groupBy("pattern", "met", "kind").agg(F.sum("belief").alias("sum"), F.count("*").alias("support"))
    sure = F.floor(F.col("sum") / F.col("met"))
    return written(score.select("pattern", "met", "kind", "support", sure.alias("confidence")).where(
        (F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).drop("support"))


def _believed(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """``value``, ``kind``, ``belief`` of candidates that confident patterns meet, and ``links``, how many patterns meet them.

    A candidate is of a kind unless all its patterns err; of several kinds it gets the
    likeliest, of equals the first. Sums are of whole numbers, so they don't depend on the order.
    """
    hit = split_join(links.drop("met"), patterns, ["pattern"], "met")
    doubt = F.floor(-1e6 * F.log(1 - F.least(F.col("confidence"), F.lit(999)) / 1000))
    sums = [F.sum(F.when(F.col("kind") == k, doubt).otherwise(0)).alias(f"s{k}") for k in range(N_BASE)]
    every = F.array(*[f"s{k}" for k in range(N_BASE)])
    best = hit.groupBy("value").agg(*sums).select(
        "value", (F.array_position(every, F.array_max(every)) - 1).cast("int").alias("kind"),
        F.floor(1000 * (1 - F.exp(-F.array_max(every) / 1e6))).alias("belief"))
    return written(best.join(links.groupBy("value").agg(F.count("*").alias("links")), "value"))


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``, ``kind``, ``confidence`` (thousandths) and ``met``, bootstrapped from the base spans.

    The graph links patterns with the identifiers they meet, each pair once, however
    often it stands. Patterns that meet fewer than SUPPORT identifiers can never be
    confident and go first. Base spans are believed; they score the patterns; what
    confident patterns meet is believed in part and scores all patterns again.
    """
    pairs = found.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(
        F.min("kind").alias("kind"), F.count("*").alias("n"))
    met = pairs.groupBy("pattern").agg(F.count("*").alias("met"), F.sum("n").alias("n")).where(F.col("met") >= SUPPORT)
    links = written(split_join(pairs.drop("n"), met.drop("n"), ["pattern"], "met"))
    seeds = links.where(F.col("kind") < N_BASE).select("pattern", "met", "kind", F.lit(1000).cast("long").alias("belief"))
    open_links = links.where(F.col("kind") == N_BASE).drop("kind")
    best = _confident(seeds)
    for _ in range(rounds):
        if best.isEmpty():
            break
        known = _believed(open_links, best)
        if known.isEmpty():
            break
        more = split_join(open_links, known, ["value"], "links")
        best = _confident(seeds.unionByName(more.select("pattern", "met", "kind", "belief")))
    return best


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The rows (``_row``, ``id``) and their spans (``_row``, ``kind``, ``start``, ``end``).

    kind is a number into NAMES; places are code points, the end exclusive. Base spans
    are all there. A candidate is a span where a confident pattern of the corpus meets
    it; of several patterns the most confident names the kind, of equals the first kind.

    A NULL or empty text has no span. Ids may be NULL or repeated: rows are told apart
    by a number of their own. Repeated rows have the same spans each, and count once as
    evidence. An empty table gives empty ones. Texts of any length are scanned whole;
    the spans of one text meet in one task, texts don't. Further columns are not looked at.
    """
    rows, found = identifiers(df, id_col, text_col)
    best = confident_patterns(found, rounds)
    asked = found.where(F.col("kind") == N_BASE).select("_row", "start", "end", F.explode("patterns").alias("pattern"))
    n = asked.groupBy("pattern").agg(F.count("*").alias("n"))
    rank = F.max(F.col("confidence") * N_BASE + (N_BASE - 1 - F.col("kind")))
    named = split_join(asked, best.drop("met").join(n, "pattern"), ["pattern"], "n").groupBy(
        "_row", "start", "end").agg(rank.alias("rank"))
    base = found.where(F.col("kind") < N_BASE).select("_row", "kind", "start", "end")
    return rows, base.unionByName(named.select(
        "_row", (2 * N_BASE - 1 - F.col("rank") % N_BASE).cast("int").alias("kind"), "start", "end"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id``, counts of the base kinds, ``base_sha256`` and ``spans`` of every row."""
    rows, spans = find_pii(df, id_col, text_col, rounds)
    lists = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("all"))
    out = rows.join(lists, "_row", "left").withColumn("all", F.coalesce(
        "all", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    own = F.filter("all", lambda s: s["kind"] < N_BASE)

    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")

    return out.select("id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                      F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_summary(documents(spark, folder)).withColumnRenamed("id", "doc_id")
