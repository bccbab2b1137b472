"""Credentials in texts, with weak candidates linked to their other parts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import documents, free_name, numbered, written

#: Code points between the starts of parts that can belong together.
SCOPE = 300

#: kind, role, pattern, group that is the secret itself (0: the whole match), its least length.
#: The first three are the base kinds; weak kinds are reported with their other parts only.
BASE_KINDS = [
    ("assign", "secret", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 6),
    ("access", "id", r"AKIA[A-Z0-9]{16,}", 2, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 2, 24),
]
WEAK_KINDS = [
    ("login", "id", r"""(?i:user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 2, 0),
    ("weak", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}", 2, 0),
    ("endpoint", "endpoint", r"""(?i:https?|ftp|jdbc:[a-z]{1,20}|mongodb|redis|amqp|postgres(?:ql)?)://[^\s"'<>]+""", 2, 0),
]
KINDS = [*BASE_KINDS, *WEAK_KINDS]
#: What must stand in the scope of a weak candidate.
NEEDS = {"login": ["secret"], "weak": ["id"], "endpoint": ["id", "secret"]}

_PART = "array<struct<kind:int,full:int,size:int,value:int>>"


def _has(text: Column, role: str) -> Column:
    tests = [text.rlike(p) for _, r, p, _, _ in KINDS if r == role]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _raw_parts(text: Column, k: int) -> Column:
    """Matches of one kind in order: length with the text since the match before, length, value's length.

    Each match is taken together with what precedes it, tied to the end of the last
    one, so lengths add up to places and the text is gone through once.
    """
    _, _, pattern, value, _ = KINDS[k]
    tied = F.lit(rf"(?s)\G(.*?)({pattern})")
    full, match = (F.regexp_extract_all(text, tied, F.lit(g)) for g in (0, 2))
    values = F.regexp_extract_all(text, tied, F.lit(3)) if value == 3 else match
    sizes = F.arrays_zip(full.alias("f"), match.alias("m"), values.alias("v"))
    return F.transform(sizes, lambda s: F.struct(
        F.lit(k).alias("kind"), F.length(s["f"]).alias("full"), F.length(s["m"]).alias("size"),
        F.length(s["v"]).alias("value")))


def _wanted(text: Column, k: int) -> Column:
    """Whether a kind is looked for in a text: it is there, and so are its other parts."""
    kind, _, pattern, _, _ = KINDS[k]
    wanted = text.rlike(pattern)
    for role in NEEDS.get(kind, []):
        wanted = _has(text, role) & wanted
    return wanted


def has_parts(text: Column) -> Column:
    """Whether a text (not NULL) has any part, that is whether it can have a span."""
    found = _wanted(text, 0)
    for k in range(1, len(KINDS)):
        found = found | _wanted(text, k)
    return found


def _scan(text: Column) -> Column:
    """Raw parts of all kinds; weak kinds are looked for only where their other parts are."""
    none = F.array().cast(_PART)
    return F.concat(*[F.when(_wanted(text, k), _raw_parts(text, k)).otherwise(none) for k in range(len(KINDS))])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """The rows (``_row``, ``id``) and their spans (``_row``, ``kind``, ``start``, ``end``).

    kind is a number into KINDS; places are code points, the end exclusive. Spans of
    the base kinds are all there. A weak candidate is a span only if a part of each
    role that it needs starts within ``scope`` code points of its start: an access
    identifier or login for a weak secret, a secret for a login, both for an endpoint.

    Weak candidates meet the other parts in a join on row and place, by cells as
    wide as the scope and their neighbours. Of each cell and role only the first and
    the last start go into the join, which is all that the test can depend on, so
    crowded cells make no pairs. A NULL text has no span. Ids may be NULL or repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = numbered(df, F.col(id_col).alias("id"), _scan(text).alias("parts"))
    flat = rows.where(F.size("parts") > 0).select("_row", F.posexplode("parts").alias("n", "p"))
    upto = Window.partitionBy("_row", "p.kind").orderBy("n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    least = F.array(*[F.lit(m) for *_, m in KINDS])
    spans = written(flat.select(
        "_row", F.col("p.kind").alias("kind"), F.sum("p.full").over(upto).alias("end"),
        F.col("p.size").alias("size"), F.col("p.value").alias("value"),
    ).where(F.col("value") >= least[F.col("kind")]).select(
        "_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))
    base = spans.where(F.col("kind") < len(BASE_KINDS))
    weak = spans.where(F.col("kind") >= len(BASE_KINDS))
    roles = F.array(*[F.lit(r) for _, r, *_ in KINDS])
    cells = spans.groupBy("_row", roles[F.col("kind")].alias("role"), F.floor(
        F.col("start") / scope).alias("cell")).agg(
            F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.array(*[F.array(*map(F.lit, NEEDS.get(k, []))).cast("array<string>") for k, *_ in KINDS])
    asks = weak.withColumn("need", needs[F.col("kind")]).select(
        "*", F.explode("need").alias("role"))
    asks = asks.select("*", F.explode(F.expr(
        f"transform(array(-1, 0, 1), d -> cast(floor(start / {scope}) + d as bigint))")).alias("cell"))
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (
        F.abs(F.col("last") - F.col("start")) <= scope)
    met = asks.join(cells, ["_row", "role", "cell"]).where(near).groupBy(
        "_row", "kind", "start", "end").agg(
            F.size(F.collect_set("role")).alias("met"), F.first(F.size("need")).alias("wanted"))
    linked = met.where(F.col("met") == F.col("wanted")).select("_row", "kind", "start", "end")
    return rows, base.unionByName(linked)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, counts of the base kinds, ``base_sha256`` and ``spans`` of every row."""
    rows, spans = find_secrets(df, id_col, text_col)
    lists = spans.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    out = rows.select("_row", "id").join(lists, "_row", "left").withColumn("all", F.coalesce(
        "all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    own = F.filter("all", lambda s: s["kind"] < len(BASE_KINDS))

    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE_KINDS)]
    return out.select("id", *counts, F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"),
                      _listed(F.col("all")).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of a text replaced by a mark; overlapping spans are one.

    All texts are searched once and written with what that told; those without any
    part are read back as they are, only the others are joined to their spans. NULL and
    empty texts stay. Ids aren't looked at; repeated rows are each redacted. An empty
    table stays empty.
    """
    row, cut, flag = free_name(df, "_row"), free_name(df, "_spans"), free_name(df, "_flag")
    marked = written(df.withColumn(flag, has_parts(F.coalesce(F.col(text_col), F.lit("")))).withColumn(
        row, F.monotonically_increasing_id()))
    kept = marked.where(F.col(flag))
    ids, spans = find_secrets(kept, row, text_col)
    along = Window.partitionBy("_row").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = spans.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(upto)).groupBy(
        "_row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = whole.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    lists = ids.join(lists, "_row").select(F.col("id").alias(row), cut)
    text, spots = F.col(text_col), F.col(cut)

    def gap(s: Column, i: Column) -> Column:
        last = F.coalesce(F.get(spots, i - 1)["end"], F.lit(0)).cast("int")
        return F.substring(text, last + 1, s["start"].cast("int") - last)

    tail = F.substring(text, F.element_at(spots, -1)["end"].cast("int") + 1, F.length(text))
    done = F.concat(F.array_join(F.concat(F.transform(spots, gap), F.array(F.lit(""))), mark), tail)
    changed = kept.join(lists, row, "left").withColumn(
        text_col, F.when(spots.isNull(), text).otherwise(done))
    return marked.where(~F.col(flag)).drop(flag, row).union(changed.select(*[F.col(f"`{c}`") for c in df.columns]))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_summary(documents(spark, folder)).withColumnRenamed("id", "doc_id")
