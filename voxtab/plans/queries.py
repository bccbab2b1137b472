"""Every operator as a query over the given tables, with its checking SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import EMOTIONS, KEYPHRASES_USED, PRICES, REMOVAL_REASONS, REPORT_TYPES
from voxtab.functions import markdown as M
from voxtab.functions import scoring as S
from voxtab.functions import text as X
from voxtab.operators import accounting as A
from voxtab.operators import clean as C
from voxtab.operators import gate as G
from voxtab.operators import profile as P
from voxtab.operators import quality as Q
from voxtab.operators import report as R
from voxtab.operators import score as SC
from voxtab.operators import summarise as U
from voxtab.operators import trained as TR
from voxtab.operators.skew import top_k
from voxtab.plans import oracle as O
from voxtab.plans.pipeline import analyse
from voxtab.sources import catalog as K
from voxtab.sources import csv as V
from voxtab.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# --- inputs ---------------------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    return K.read_table(spark, d, "documents")


def chats(spark: SparkSession, d: str) -> DataFrame:
    df = K.read_table(spark, d, "conversations")
    return df.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def kept(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return C.clean(docs(spark, d).select("doc_id", "text", *extra), "text", "doc_id")


def scored(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return SC.score(kept(spark, d, *extra), "text")


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


SCORED_SQL = [*O.comments(), O.SCORED]
TOPIC_SQL = [*SCORED_SQL, O.TOPICS]
ENTITY_SQL = [*SCORED_SQL, O.entities(), O.ENTITY_TOP]
GATE_SQL = [*TOPIC_SQL, O.topic_summary(), O.entities(), O.ENTITY_TOP, O.GATE]

# --- A: sources and sinks -------------------------------------------------------------------


@query("""SELECT event_id, event_type, CASE WHEN value >= 20 THEN round(sqrt(value - 20), 6) END
  AS root FROM events ORDER BY event_id LIMIT 5""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    root = F.round(F.sqrt(F.col("value") - 20), 6).alias("root")
    return K.preview(K.read_table(spark, d, "events").select("event_id", "event_type", root),
                     "event_id")


@query("""SELECT count(*) AS n_rows, 6::BIGINT AS n_columns,
  'event_id,ts,user_id,event_type,value,props' AS columns FROM events""")
def table_shape(spark: SparkSession, d: str) -> DataFrame:
    return K.table_shape(K.read_table(spark, d, "events")).withColumn(
        "columns", F.array_join("columns", ","))


@query("""SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
  'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment})::VARCHAR AS json FROM customer""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    return K.json_records(K.read_table(spark, d, "customer"))


@query("SELECT doc_id, n_chars, lang AS upload_id FROM documents WHERE lang = 'fr'")
def upload_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Each language saved as an upload; one of them read back from its own folder."""
    folder = f"{K.shared_folder(spark)}/uploads-{uuid.uuid4().hex}"
    table = K.read_table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    K.save_uploads(table, folder, "lang")
    return K.load_upload(spark, folder, "fr")


@query("""SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The documents as CSV files, with line breaks inside quotes, read back."""
    folder = f"{K.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table = docs(spark, d).select("doc_id", "lang", "text")
    table.write.options(sep=";", header=True, escape='"', quoteAll=True).csv(folder)
    return V.read_feedback_csv(spark, folder).drop("row_id")


@query("""SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents""")
def csv_mixed_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV files of two delimiters and column orders, each read by its own header."""
    folder = f"{K.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for part, sep, columns in ((0, ";", ["doc_id", "lang", "text"]), (1, ",", ["text", "doc_id", "lang"])):
        docs(spark, d).where(F.col("doc_id") % 2 == part).select(*columns).write.mode("append").options(
            sep=sep, header=True, escape='"', quoteAll=True).csv(folder)
    return V.read_csv_folder(spark, folder)[0].select("doc_id", "lang", "text")


@query("""SELECT doc_id % 2 AS part, count(*) FILTER (doc_id % 3 <> 0) AS rows,
  count(*) FILTER (doc_id % 3 = 0) AS skipped FROM documents GROUP BY 1""")
def csv_skipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a cell too many, counted per file and summed by kind of file."""
    folder = f"{K.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for part, sep, names in ((0, "\t", ["id", "lang"]), (1, ",", ["id", "language"])):
        cell = F.concat(F.lit("l"), F.when(F.col("doc_id") % 3 == 0, F.lit(f"{sep}more")).otherwise(F.lit("")))
        docs(spark, d).where(F.col("doc_id") % 2 == part).select("doc_id", cell).toDF(*names).write.options(
            sep=sep, header=True, quote="").csv(f"{folder}/kind={part}")
    part = F.regexp_extract("file", r"kind=([0-9])", 1).cast("long").alias("part")
    return V.read_csv_folder(spark, f"{folder}/*")[1].groupBy(part).agg(
        F.sum("rows").alias("rows"), F.sum("skipped").alias("skipped"))


@query("""SELECT doc_id, n_chars + CASE WHEN lang IN ('fr', 'de') THEN 0 ELSE 1 END AS n_chars,
  lang AS upload_id FROM documents""")
def upload_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of all languages, of which two are saved again: those are replaced, the others stay."""
    folder = f"{K.shared_folder(spark)}/uploads-{uuid.uuid4().hex}"
    table = K.read_table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    K.save_uploads(table.withColumn("n_chars", F.col("n_chars") + 1), folder, "lang")
    for _ in range(2):
        K.save_uploads(table.where(F.col("lang").isin("fr", "de")), folder, "lang")
    return spark.read.parquet(folder)


# --- B: text column ---------------------------------------------------------------------------


def _profiles(spark: SparkSession, d: str, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    out = None
    for table, (key, columns, _) in O.PROFILED.items():
        one = make(K.read_table(spark, d, table).select(*columns), key).withColumn(
            "tbl", F.lit(table))
        out = one if out is None else out.unionByName(one)
    return out


@query(O.with_(O.heads(), body="""SELECT tbl, col, count(*) AS n, sum(length(value))::BIGINT AS chars
  FROM heads GROUP BY 1, 2"""))
def column_heads(spark: SparkSession, d: str) -> DataFrame:
    def heads(df: DataFrame, key: str) -> DataFrame:
        days = F.endswith("value", F.lit(" 00:00:00"))
        shown = F.when(days, 10).otherwise(F.length("value"))
        return P.column_heads(df, key).withColumn("chars", shown)

    return _profiles(spark, d, heads).groupBy("tbl", F.col("column").alias("col")).agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(O.with_(O.heads(), O.COLUMN_SCORES, body="""SELECT tbl, col, round(len, 6) AS mean_length,
  round(sp, 6)::DOUBLE AS space_share, ns::DOUBLE AS name_score, ls::DOUBLE AS length_score,
  ss::DOUBLE AS space_score, round(confidence, 6)::DOUBLE AS confidence FROM col_scores"""))
def column_scores(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d, P.column_confidence).select(
        "tbl", F.col("column").alias("col"), rounded("mean_length"), rounded("space_share"),
        "name_score", "length_score", "space_score", rounded("confidence"))


@query(O.with_(O.heads(), O.COLUMN_SCORES, """ranked AS (SELECT *, row_number() OVER
  (PARTITION BY tbl ORDER BY confidence DESC, position) AS rank FROM col_scores
  WHERE confidence > 0)""", """shown AS (SELECT tbl, col, string_agg(CASE WHEN length(value) > 100
  THEN substring(value, 1, 97) || '...' ELSE value END, chr(10) ORDER BY nr) AS samples
  FROM heads WHERE nr <= 3 GROUP BY 1, 2)""", body="""SELECT tbl, rank, col,
  round(confidence, 6)::DOUBLE AS confidence, samples FROM ranked JOIN shown USING (tbl, col)
  WHERE rank <= 3"""))
def text_column_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d, P.text_column_candidates).select(
        "tbl", F.col("rank").cast("long").alias("rank"), F.col("column").alias("col"),
        rounded("confidence"), F.array_join("sample_values", "\n").alias("samples"))


_HINT = "LANG"


@query(O.with_(O.heads(), O.COLUMN_SCORES, f"""hinted AS (SELECT *, lower(col) = lower('{_HINT}') AS hint,
  CASE WHEN lower(col) = lower('{_HINT}') THEN 1.0 ELSE confidence END AS sure FROM col_scores)""",
               """ranked AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY sure DESC, position) AS rank
  FROM hinted WHERE sure > 0)""", body="""SELECT tbl, rank, col, round(sure, 6)::DOUBLE AS confidence, hint
  FROM ranked WHERE rank <= 3"""))
def hinted_columns(spark: SparkSession, d: str) -> DataFrame:
    """Candidates where the user names a column in another case; tables without it are ranked as usual."""
    return _profiles(spark, d, lambda df, key: P.text_column_candidates(df, key, hint=_HINT)).select(
        "tbl", F.col("rank").cast("long").alias("rank"), F.col("column").alias("col"), rounded("confidence"),
        (F.col("reason") == "Exact match with user hint").alias("hint"))


# --- C: cleaning -------------------------------------------------------------------------------


@query(O.with_(*O.comments(), body="SELECT id AS doc_id, t AS text FROM kept"))
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d)


@query(O.with_(O.PAGES, O.CLEANED, body="SELECT id AS page_id, t AS clean_text FROM cleaned"))
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = K.read_table(spark, d, "pages").select("page_id", "html")
    return C.with_clean_text(pages, "html").select("page_id", "clean_text")


@query(O.with_(*O.comments(), body="SELECT id AS doc_id, reason AS removal_reason FROM marked"))
def removal_reasons(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(docs(spark, d).select("doc_id", "text"), "text", "doc_id").select(
        "doc_id", "removal_reason")


@query(O.with_(*O.comments(by_group=True),
               body="SELECT id AS doc_id, g AS source, t AS text FROM kept"))
def clean_per_source(spark: SparkSession, d: str) -> DataFrame:
    return C.clean(docs(spark, d).select("doc_id", "source", "text"), "text", "doc_id", ["source"])


_LEDGER = " UNION ALL ".join(
    f"SELECT '{r}' AS reason, count(*) FILTER (reason = '{r}') AS cnt FROM marked"
    for r in REMOVAL_REASONS) + (
    " UNION ALL SELECT 'keep', count(*) FILTER (reason IS NULL) FROM marked")


def _ledger_query(name: str, source: str, read: Callable[[SparkSession, str], DataFrame],
                  text_col: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.removal_ledger(read(spark, d), text_col)

    run.__name__ = name
    query(O.with_(*O.comments(source), body=_LEDGER))(run)


_ledger_query("ledger_documents", O.DOCS, docs, "text")
_ledger_query("ledger_pages", O.PAGES,
              lambda s, d: K.read_table(s, d, "pages"), "html")
_ledger_query("ledger_conversations", O.CHATS, chats, "text")


@query(O.with_(O.DOCS, O.CLEANED, O.JUDGED, body=r"""SELECT id AS doc_id, coalesce(r0 = 'spam',
  false) AS spam, length(t) > 10 AND length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) / length(t)
  > 0.7 AS shouting FROM judged"""))
def spam_flags(spark: SparkSession, d: str) -> DataFrame:
    cleaned = C.with_clean_text(docs(spark, d).select("doc_id", "text"), "text")
    t = F.col("clean_text")
    return cleaned.select("doc_id", X.is_spam(t).alias("spam"), X.is_shouting(t).alias("shouting"))


_STATS = """stats AS (SELECT g, count(*) AS total_rows,
  count(*) FILTER (reason IS NULL) AS rows_after_cleaning,
  count(*) FILTER (reason = 'spam') AS spam, count(*) FILTER (reason = 'duplicate') AS duplicate,
  avg(length(t)) FILTER (reason IS NULL) AS avg_text_length,
  min(length(t)) FILTER (reason IS NULL) AS min_text_length,
  max(length(t)) FILTER (reason IS NULL) AS max_text_length,
  count(*) FILTER (reason IS NOT NULL) AS removed_rows FROM marked GROUP BY g)"""


@query(O.with_(*O.comments(by_group=True), _STATS, body="""SELECT g AS source, total_rows,
  rows_after_cleaning, spam, duplicate, round(avg_text_length, 6) AS avg_text_length,
  min_text_length, max_text_length, removed_rows FROM stats"""))
def data_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = C.data_stats(docs(spark, d).select("source", "text"), "text", ["source"])
    return stats.select("source", "total_rows", "rows_after_cleaning", "spam", "duplicate",
                        rounded("avg_text_length"), "min_text_length", "max_text_length",
                        "removed_rows")


@query(O.with_(*O.comments(by_group=True), _STATS, body="""SELECT g AS source,
  CASE WHEN rows_after_cleaning < 45 THEN 'fail' WHEN removed_rows > total_rows * 0.5
  THEN 'warning' ELSE 'pass' END AS status,
  (CASE WHEN removed_rows > total_rows * 0.3 THEN 1 ELSE 0 END)
  + (CASE WHEN avg_text_length < 10 THEN 1 ELSE 0 END) AS n_warnings FROM stats"""))
def validation_verdict(spark: SparkSession, d: str) -> DataFrame:
    stats = C.data_stats(docs(spark, d).select("source", "text"), "text", ["source"])
    return C.validation_verdict(stats, min_rows=45).select(
        "source", "status", F.size("warnings").alias("n_warnings"))


@query(f"""SELECT lang, round(avg(hit), 6) AS english_share,
  CASE WHEN avg(hit) > 0.5 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT lang,
  CASE WHEN regexp_matches(lower(text), '{O.ENGLISH}') THEN 1.0 ELSE 0.0 END AS hit,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
  WHERE n <= 20 GROUP BY lang""")
def language_guess(spark: SparkSession, d: str) -> DataFrame:
    return C.language_guess(docs(spark, d), "text", "doc_id", group_cols=["lang"]).select(
        "lang", rounded("english_share"), "language")


# --- D: scores ------------------------------------------------------------------------------


@query(O.with_(*O.comments(), O.TOPICS, body="""SELECT id AS doc_id, topic, rn AS rank,
  round(1.0 / rn, 6) AS relevance FROM topics"""))
def topics(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["topics"])
    return s.select("doc_id", "topics.relevance_scores",
                    F.posexplode("topics.topics").alias("i", "topic")).select(
        "doc_id", "topic", (F.col("i") + 1).cast("long").alias("rank"),
        F.round(F.element_at("relevance_scores", F.col("topic")), 6).alias("relevance"))


@query(O.with_(*O.comments(), O.TOPICS, body="""SELECT topic AS primary_topic, count(*) AS cnt
  FROM topics WHERE rn = 1 GROUP BY 1"""))
def primary_topics(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["topics"])
    return s.groupBy("topics.primary_topic").agg(F.count("*").alias("cnt"))


@query(O.with_(*SCORED_SQL, body="""SELECT id AS doc_id, label, round(score, 6) AS score,
  round(se[1] / list_sum(se), 6) AS negative, round(se[2] / list_sum(se), 6) AS neutral,
  round(se[3] / list_sum(se), 6) AS positive FROM scored"""))
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment"])
    return s.select("doc_id", "sentiment.label", rounded("sentiment.score").alias("score"), *[
        F.round(F.col("sentiment.scores")[n], 6).alias(n)
        for n in ("negative", "neutral", "positive")])


@query(O.with_(*SCORED_SQL, body="""SELECT id AS doc_id, emotion,
  round(confidence, 6) AS confidence, """ + ", ".join(
    f"round(ee[{i}] / list_sum(ee), 6) AS {e}" for i, e in enumerate(EMOTIONS, 1))
    + " FROM scored"))
def emotion(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["emotion"])
    return s.select("doc_id", "emotion.emotion", rounded("emotion.confidence").alias("confidence"),
                    *[F.round(F.col("emotion.scores")[e], 6).alias(e) for e in EMOTIONS])


@query(O.with_(*O.comments(), O.entities(), body="""SELECT id AS doc_id, txt AS text, kind AS type,
  s AS start, e AS "end", confidence::DOUBLE AS confidence FROM ents"""))
def entities(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["entities"])
    return s.select("doc_id", F.inline("entities"))


GAZETTEER = {"Apache License": "LICENSE", "Public License": "LICENSE", "MIT": "ORG"}


@query(O.with_(*O.comments(), O.entities(GAZETTEER), body="""SELECT id AS doc_id, txt AS text,
  kind AS type, s AS start, e AS "end", confidence::DOUBLE AS confidence FROM ents"""))
def entities_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame(list(GAZETTEER.items()), "name string, type string")
    comments = K.written(kept(spark, d))
    found = SC.entities_with_gazetteer(comments, "text", "doc_id", names)
    return found.select("doc_id", F.inline("entities"))


@query(O.with_(*O.comments(), O.TOPICS, O.PHRASES, body="""SELECT id AS doc_id, rank, phrase,
  round(score, 6) AS score FROM phrases"""))
def keyphrases(spark: SparkSession, d: str) -> DataFrame:
    return SC.keyphrases(K.written(kept(spark, d)), "text", "doc_id").select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "phrase", rounded("score"))


@query(O.with_(*O.comments(), O.TOPICS, O.PHRASES, body="""SELECT id AS doc_id,
  count(phrase) AS n, max(CASE WHEN rank = 1 THEN phrase END) AS best,
  round(sum(score), 6) AS total FROM kept LEFT JOIN phrases USING (id) GROUP BY id"""))
def keyphrase_records(spark: SparkSession, d: str) -> DataFrame:
    rows = SC.with_keyphrases(K.written(kept(spark, d)), "text", "doc_id")
    total = F.aggregate(F.map_values("keyphrases.scores"), F.lit(0.0), lambda a, x: a + x)
    n = F.size("keyphrases.keyphrases")
    return rows.select("doc_id", n.cast("long").alias("n"),
                       F.get("keyphrases.keyphrases", F.lit(0)).alias("best"),
                       F.when(n > 0, F.round(total, 6)).alias("total"))


@query(O.with_(*O.comments(), body="""SELECT 'neutral' AS emotion, 0.0::DOUBLE AS confidence,
  0 AS phrases, count(*) AS cnt FROM kept"""))
def disabled_scorers(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment", "topics", "entities"])
    return s.groupBy("emotion.emotion", "emotion.confidence",
                     F.size("keyphrases.keyphrases").alias("phrases")).agg(
        F.count("*").alias("cnt"))


def shares_of_capitals():
    """A stand-in for a user model; built here so that it travels to the workers by value."""
    def load():
        def run(texts: list[str]) -> list[dict]:
            shares = [sum(c.isupper() for c in t) / len(t) for t in texts]
            return [{"label": "loud" if s > 0.1 else "calm", "score": s} for s in shares]

        return run

    return load


MODEL_SCHEMA = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

_SHOUT_SQL = r"""shout AS (SELECT id, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))
  / length(t) AS s FROM {0})"""
_SHOUT_OUT = """SELECT id AS doc_id, CASE WHEN s > 0.1 THEN 'loud' ELSE 'calm' END AS label,
  round(s, 6) AS score FROM shout"""


@query(O.with_(*O.comments(), _SHOUT_SQL.format("kept"), body=_SHOUT_OUT))
def user_scorer(spark: SparkSession, d: str) -> DataFrame:
    rows = SC.apply_scorer(kept(spark, d), "text", shares_of_capitals(), "mood", MODEL_SCHEMA)
    return rows.select("doc_id", "mood.label", F.round("mood.score", 6).alias("score"))


@query(O.with_(O.DOCS, O.CLEANED, O.JUDGED, _SHOUT_SQL.format("judged"), body=_SHOUT_OUT))
def score_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_clean_text(docs(spark, d).select("doc_id", "text"), "text").select(
        "doc_id", F.col("clean_text").alias("text"))
    out = SC.score_distinct(rows, "text", lambda t: SC.apply_scorer(
        t, "text", shares_of_capitals(), "mood", MODEL_SCHEMA))
    return out.select("doc_id", "mood.label", F.round("mood.score", 6).alias("score"))


@query(O.with_(*O.comments(), body="""SELECT id AS doc_id, 'comment_' ||
  (row_number() OVER (ORDER BY id) - 1) AS comment_id FROM kept"""))
def comment_ids(spark: SparkSession, d: str) -> DataFrame:
    return SC.comment_ids(kept(spark, d), "doc_id")


@query(O.with_(*TOPIC_SQL, O.entities(), body="""SELECT s.id AS doc_id, label, emotion,
  (SELECT topic FROM topics t WHERE t.id = s.id AND rn = 1) AS primary_topic,
  (SELECT count(*) FROM ents e WHERE e.id = s.id) AS n_entities FROM scored s"""))
def comment_records(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(
        "doc_id", "sentiment.label", "emotion.emotion", "topics.primary_topic",
        F.size("entities").cast("long").alias("n_entities"))


# --- D3: a scorer that learns --------------------------------------------------------------------

#: Part of the labelled documents, by id, from which nothing is learned.
HELD_OUT_PART, HELD_OUT_OF = 0, 5


def _trained(spark: SparkSession, d: str) -> DataFrame:
    """All documents with the sentiment of a model of ``labels`` (toxic: negative) and, where known, the true one."""
    labels = K.read_table(spark, d, "labels").select("doc_id", (1 - F.col("toxic")).alias("good"))
    table = docs(spark, d).select("doc_id", "text").join(labels, "doc_id", "left")
    model = TR.fit_scorer(table.where(F.col("doc_id") % HELD_OUT_OF != HELD_OUT_PART), "text", "good")
    truth = F.when(F.col("good") == 1, "positive").when(F.col("good") == 0, "negative")
    return TR.sentiment_scorer(model)(table, "text").withColumn("truth", truth)


@query()
def trained_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d).select(
        "doc_id", "sentiment.label", rounded("sentiment.score").alias("score"), "truth")


@query(f"""SELECT count(*) AS scored, count(*) AS whole, count(*) AS likeliest, count(*) AS in_bounds,
  count(*) FILTER (toxic IS NOT NULL AND doc_id % {HELD_OUT_OF} = {HELD_OUT_PART}) AS held_out
  FROM documents LEFT JOIN labels USING (doc_id)""")
def trained_sentiment_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Rows scored; those whose scores sum to 1, name the likeliest label, and lie within bounds; rows held out."""
    s = F.col("sentiment")
    values = F.map_values(s["scores"])
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    held = F.col("truth").isNotNull() & (F.col("doc_id") % HELD_OUT_OF == HELD_OUT_PART)
    return _trained(spark, d).agg(
        F.count("*").alias("scored"), F.count_if(F.abs(total - 1) < 1e-9).alias("whole"),
        F.count_if((s["scores"][s["label"]] == s["score"]) & (F.array_max(values) == s["score"])).alias("likeliest"),
        F.count_if(F.forall(values, lambda v: v.between(0, 1))).alias("in_bounds"), F.count_if(held).alias("held_out"))


# --- E: summaries --------------------------------------------------------------------------------

_DIST = "SELECT {0} AS label, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM scored GROUP BY {0}"


@query(O.with_(*SCORED_SQL, body=_DIST.format("label")))
def sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment"])
    return U.sentiment_distribution(s).withColumn("pct", F.round("pct", 6))


@query(O.with_(*SCORED_SQL, body=_DIST.format("emotion")))
def emotion_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["emotion"])
    return U.emotion_distribution(s).withColumn("pct", F.round("pct", 6))


@query(O.with_(*SCORED_SQL, body="""SELECT g AS source, label, count(*) AS cnt,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY g), 6) AS pct
  FROM scored GROUP BY g, label"""))
def sentiment_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d, "source"), "text", ["sentiment"])
    return U.sentiment_distribution(s, ["source"]).withColumn("pct", F.round("pct", 6))


@query(O.with_(*SCORED_SQL, body="""SELECT count(*) AS total_comments,
  round(avg(v), 6) AS mean_value FROM valued"""))
def totals(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment"])
    return s.agg(F.count("*").alias("total_comments"),
                 F.round(F.avg(S.sentiment_value(F.col("sentiment.label"))), 6).alias("mean_value"))


@query(O.with_(*TOPIC_SQL, O.topic_summary(), body="""SELECT rank, topic, cnt,
  round(avg_sentiment, 6) AS avg_sentiment FROM topic_top"""))
def topic_summary(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment", "topics"])
    return U.topic_summary(s, "text", "doc_id", samples=0).select(
        F.col("rank").cast("long").alias("rank"), "topic", "cnt", rounded("avg_sentiment"))


@query(O.with_(*TOPIC_SQL, O.topic_summary(), body="""SELECT topic, n, sample FROM (SELECT topic,
  substring(t, 1, 100) AS sample, row_number() OVER (PARTITION BY topic ORDER BY id, rn) AS n
  FROM topics JOIN valued USING (id) WHERE rn <= 3 AND topic IN (SELECT topic FROM topic_top))
  WHERE n <= 5"""))
def topic_samples(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment", "topics"])
    return U.topic_summary(s, "text", "doc_id").select(
        "topic", F.posexplode("sample_comments").alias("i", "sample")).select(
        "topic", (F.col("i") + 1).cast("long").alias("n"), "sample")


@query(O.with_(*TOPIC_SQL, O.topic_summary(by_group=True), body="""SELECT g AS source, rank, topic,
  cnt, round(avg_sentiment, 6) AS avg_sentiment FROM topic_top"""))
def topics_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d, "source"), "text", ["sentiment", "topics"])
    return U.topic_summary(s, "text", "doc_id", samples=0, group_cols=["source"]).select(
        "source", F.col("rank").cast("long").alias("rank"), "topic", "cnt",
        rounded("avg_sentiment"))


@query(O.with_(*ENTITY_SQL, body="""SELECT rank, txt AS text, kind AS type, cnt,
  round(sentiment, 6) AS sentiment FROM entity_top"""))
def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment", "entities"])
    return U.entity_summary(s, "text", "doc_id", contexts=0).select(
        F.col("rank").cast("long").alias("rank"), "text", "type", "cnt", rounded("sentiment"))


@query(O.with_(*ENTITY_SQL, body="""SELECT txt AS text, kind AS type, n, context FROM (
  SELECT txt, kind, substring(t, 1, 100) AS context,
  row_number() OVER (PARTITION BY txt, kind ORDER BY id, pos) AS n FROM ents JOIN valued USING (id)
  WHERE (txt, kind) IN (SELECT (txt, kind) FROM entity_top)) WHERE n <= 3"""))
def entity_contexts(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment", "entities"])
    return U.entity_summary(s, "text", "doc_id").select(
        "text", "type", F.posexplode("contexts").alias("i", "context")).select(
        "text", "type", (F.col("i") + 1).cast("long").alias("n"), "context")


@query(O.with_(*O.comments(), O.TOPICS, O.PHRASES, O.PHRASE_TOP,
               body="SELECT rank, phrase AS keyphrase, cnt FROM phrase_top"))
def top_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    rows = SC.with_keyphrases(K.written(kept(spark, d)), "text", "doc_id")
    return U.top_keyphrases(rows, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query(O.with_(*O.comments(), O.TOPICS, O.PHRASES, O.GROUP_PHRASE_TOP,
               body="SELECT g AS source, rank, phrase AS keyphrase, cnt FROM group_phrase_top"))
def keyphrases_by_source(spark: SparkSession, d: str) -> DataFrame:
    comments = K.written(kept(spark, d, "source"))
    first = SC.keyphrases(comments, "text", "doc_id", KEYPHRASES_USED, ["source"])
    phrases = first.select("doc_id", "source", F.col("phrase").alias("keyphrase"), (F.col("rank") - 1).alias("pos"))
    return U.keyphrase_ranking(phrases, "doc_id", "pos", group_cols=["source"]).select(
        "source", F.col("rank").cast("long").alias("rank"), "keyphrase", "cnt")


@query(O.with_(*SCORED_SQL, body="""SELECT count(*) AS n, round(avg(score), 6) AS
  sentiment_confidence, round(avg(confidence) FILTER (confidence > 0), 6) AS emotion_confidence,
  round((avg(score) + avg(confidence) FILTER (confidence > 0)) / 2, 6) AS confidence
  FROM scored"""))
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d), "text", ["sentiment", "emotion"])
    return U.mean_confidence(s).select(
        "n", *[rounded(c) for c in ("sentiment_confidence", "emotion_confidence", "confidence")])


# --- F: quality gate -------------------------------------------------------------------------------


def _gate(spark: SparkSession, d: str) -> DataFrame:
    comments = K.written(kept(spark, d))
    s = K.written(SC.score(comments, "text").select(
        "doc_id", F.substring("text", 1, 100).alias("sample"), "sentiment", "emotion", "topics",
        "entities"))
    return G.gate_inputs(comments, s, U.topic_summary(s, "sample", "doc_id", samples=0),
                         U.entity_summary(s, "sample", "doc_id", contexts=0))


@query(O.with_(*GATE_SQL, body="""SELECT check_order, name, passed, round(score, 6) AS score
  FROM checks"""))
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    return G.quality_checks(_gate(spark, d)).select("check_order", "name", "passed",
                                                    rounded("score"))


@query(O.with_(*GATE_SQL, body="""SELECT round(sum(score * weight) / sum(weight), 6)
  AS quality_score, CASE WHEN bool_or(NOT passed AND name IN ('Data Coverage', 'Confidence Check'))
  THEN 'fail' WHEN sum(score * weight) / sum(weight) >= 70 THEN 'pass'
  WHEN sum(score * weight) / sum(weight) >= 60 THEN 'warning' ELSE 'fail' END AS status,
  NOT bool_or(NOT passed AND name IN ('Data Coverage', 'Confidence Check'))
  AND sum(score * weight) / sum(weight) >= 60 AS should_proceed,
  count(*) FILTER (NOT passed AND score < 50) AS n_issues,
  count(*) FILTER (NOT passed) AS n_recommendations FROM checks JOIN weights USING (name)"""))
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = G.quality_verdict(G.quality_checks(_gate(spark, d)))
    return v.select(rounded("quality_score"), "status", "should_proceed",
                    F.size("issues").cast("long").alias("n_issues"),
                    F.size("recommendations").cast("long").alias("n_recommendations"))


@query(O.with_(*GATE_SQL, body="""SELECT round(conf, 6) AS avg_confidence,
  processed / total AS data_coverage, nt AS num_topics, ne AS num_entities FROM facts"""))
def gate_metadata(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_metadata(_gate(spark, d)).select(
        rounded("avg_confidence"), "data_coverage", "num_topics", "num_entities")


# --- G: report metrics --------------------------------------------------------------------------------


@query(O.with_(*TOPIC_SQL, O.topic_summary(by_group=True), body="""SELECT g AS source, topic,
  CASE WHEN avg_sentiment > 0.3 THEN 'positive' WHEN avg_sentiment < -0.3 THEN 'negative'
  ELSE 'neutral' END AS band FROM topic_top WHERE rank <= 5"""))
def report_topics(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d, "source"), "text", ["sentiment", "topics"])
    top = U.topic_summary(s, "text", "doc_id", samples=0, group_cols=["source"])
    return R.report_slice(top, 5).select(
        "source", "topic", S.sentiment_band(F.col("avg_sentiment")).alias("band"))


_TYPES = ", ".join(f"({O.quoted(n)}, {O.quoted(p)}, {len(g)})" for n, _, p, g in REPORT_TYPES)
_TITLES = ", ".join(f"({O.quoted(n)}, {O.quoted(t)})" for n, t, _, _ in REPORT_TYPES)


@query(f"""WITH types(name, target_pages, n) AS (VALUES {_TYPES}) SELECT role, target_pages,
  n AS guideline_length, count(*) AS cnt FROM (SELECT role, CASE role WHEN 'user' THEN 'product'
  WHEN 'assistant' THEN 'marketing' ELSE 'other' END AS report_type FROM conversations)
  JOIN types ON name = CASE WHEN report_type = 'other' THEN 'executive' ELSE report_type END
  GROUP BY ALL""")
def report_guidelines(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "product").when(
        F.col("role") == "assistant", "marketing").otherwise("other")
    rows = chats(spark, d).withColumn("report_type", kind)
    return R.with_guideline(rows).groupBy(
        "role", "target_pages", F.length("guideline").alias("guideline_length")).agg(
        F.count("*").alias("cnt"))


@query(f"""WITH titles(name, title) AS (VALUES {_TITLES}), plans AS (SELECT role, CASE role
  WHEN 'user' THEN 'customer_service' WHEN 'assistant' THEN 'product' ELSE 'executive' END AS name
  FROM conversations), sections(section, priority) AS (VALUES ('Executive Summary', 'high'),
  ('Sentiment Analysis', 'high'), ('Key Topics', 'medium'), ('Recommendations', 'high'))
  SELECT title, section, priority, count(*) AS cnt FROM plans JOIN titles USING (name), sections
  GROUP BY ALL""")
def default_outlines(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "customer_service").when(
        F.col("role") == "assistant", "product").otherwise("executive")
    rows = R.with_outline(chats(spark, d).withColumn("report_type", kind))
    return rows.select("outline.title", F.explode("outline.sections").alias("s")).groupBy(
        "title", F.col("s.name").alias("section"), "s.priority").agg(F.count("*").alias("cnt"))


@query(O.with_(*SCORED_SQL, """shares AS (SELECT g, count(*) AS n,
  count(*) FILTER (label = 'positive') * 100.0 / count(*) AS pct FROM scored GROUP BY g)""",
  body="""SELECT g AS source, CASE WHEN pct >= 80 THEN 'excellent' WHEN pct >= 60 THEN 'good'
  WHEN pct >= 40 THEN 'mixed' WHEN pct >= 20 THEN 'concerning' ELSE 'critical' END AS mood,
  CASE WHEN n >= 1000 THEN 'statistical significance' WHEN n >= 200 THEN 'high confidence'
  WHEN n >= 50 THEN 'reliable insights' WHEN n >= 10 THEN 'basic trends' ELSE 'too small' END
  AS sample_size FROM shares"""))
def reading_bands(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d, "source"), "text", ["sentiment"])
    shares = s.groupBy("source").agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("sentiment.label") == "positive") * 100.0 / F.count("*")).alias("pct"))
    return shares.select("source", R.positive_share_band(F.col("pct")).alias("mood"),
                         R.sample_size_band(F.col("n")).alias("sample_size"))


@query(O.with_(*TOPIC_SQL, O.topic_summary(by_group=True), body="""SELECT g AS source,
  string_agg(format('- {}: {} mentions ({} sentiment: {:.2f})', topic, cnt, CASE
  WHEN avg_sentiment > 0.3 THEN 'positive' WHEN avg_sentiment < -0.3 THEN 'negative'
  ELSE 'neutral' END, avg_sentiment::DOUBLE), chr(10) ORDER BY rank) AS lines
  FROM topic_top WHERE rank <= 5 GROUP BY g"""))
def report_topic_lines(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d, "source"), "text", ["sentiment", "topics"])
    top = U.topic_summary(s, "text", "doc_id", samples=0, group_cols=["source"])
    return R.lines(R.report_slice(top, 5), R.topic_line(), [F.col("rank")], ["source"])


@query(O.with_(*SCORED_SQL, """counts AS (SELECT g, emotion, count(*) AS cnt, min(id) AS first
  FROM scored GROUP BY 1, 2)""", """shares AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY g) * 100
  AS pct FROM counts)""", body="""SELECT g AS source, string_agg(format('- {}: {} ({:.1f}%)',
  emotion, cnt, pct), chr(10) ORDER BY cnt DESC, first) AS lines FROM shares GROUP BY g"""))
def report_distribution_lines(spark: SparkSession, d: str) -> DataFrame:
    s = SC.score(kept(spark, d, "source"), "text", ["emotion"])
    dist = U.emotion_distribution(s, ["source"], "doc_id")
    return R.lines(dist, R.distribution_line(), [-F.col("cnt"), F.col("first_id")], ["source"])


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN
  'Turn ' || turn ELSE 'Product Sentiment Analysis Report' END AS title,
  (CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 4 END)::BIGINT AS estimated_sections,
  CASE WHEN length(text) % 3 = 0 THEN '1. Only (priority: low)' ELSE '1. Executive Summary '
  || '(priority: high)' || chr(10) || '2. Sentiment Analysis (priority: high)' || chr(10)
  || '3. Key Topics (priority: medium)' || chr(10) || '4. Recommendations (priority: high)' END
  AS sections FROM conversations""")
def parsed_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Fenced JSON plans for some texts, broken or partial ones for the rest."""
    n = F.length("text") % 3
    plan = F.format_string(
        '```json\n{"title": "Turn %d", "recommended_length": "1 page", "sections": [{"name": '
        '"Only", "priority": "low", "key_points": [], "data_sources": [], "estimated_length": '
        '"short"}]}\n```', "turn")
    answer = F.when(n == 0, plan).when(n == 1, '{"title": "no sections"}').otherwise("no json {")
    rows = chats(spark, d).select("conv_id", "turn", answer.alias("answer"),
                                  F.lit("product").alias("report_type"))
    return R.with_outline(rows, answer_col="answer").select(
        "conv_id", "turn", "outline.title", "estimated_sections",
        R.expected_section_lines(F.col("outline.sections")).alias("sections"))


@query()
def report_brief(spark: SparkSession, d: str) -> DataFrame:
    return analyse(K.read_table(spark, d, "documents"), "text", "doc_id", ["source"],
                   "product").brief


# --- H: report quality -----------------------------------------------------------------------------


def _clean_reports(turns: DataFrame) -> DataFrame:
    """Markdown texts made from chat turns, cleaned."""
    md = F.concat(
        F.lit("  ```markdown\n# Conversation "), "conv_id", F.lit("\n## **Turn "), "turn",
        F.lit("**\n"), "text", F.lit("\n\n\n\n### Next __steps__\n"),
        F.when(F.length("text") > 400, "We recommend more.").otherwise("None."),
        F.lit("\n```\n"))
    return turns.withColumn("body", M.clean_markdown(md)).drop("text")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return K.read_table(spark, d, "conversations").select("conv_id", "turn", "text")


@query(O.with_(O.REPORTS, O.CLEAN_MD, body="SELECT conv_id, turn, body FROM clean_md"))
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _clean_reports(_answers(spark, d)).select("conv_id", "turn", "body")


@query(O.with_(O.REPORTS, O.CLEAN_MD, body=r"""SELECT conv_id, turn, array_to_string(list_transform(
  regexp_extract_all(body, '(?m)^#{2,3}\s+(.+)$', 1), lambda x: replace(replace(trim(x), '**', ''),
  '__', '')), '|') AS headings FROM clean_md"""))
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    return _clean_reports(_answers(spark, d)).select(
        "conv_id", "turn", F.array_join(M.section_headings(F.col("body")), "|").alias("headings"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(text, ' ' || chr(10))
  ELSE text END AS body FROM conversations""")
def strip_fences(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```\n"))
    answer = F.when(F.col("role") == "user", F.col("text")).otherwise(fenced)
    return chats(spark, d).select("conv_id", "turn", M.strip_fence(answer).alias("body"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))
  AS n_words FROM documents""")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("n_words"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return Q.evaluate_text(_clean_reports(_answers(spark, d)), "body", min_score=72.0)


@query(O.with_(O.REPORTS, O.CLEAN_MD, O.HEURISTIC, body="""SELECT conv_id, turn,
  round(overall, 6) AS overall, CASE WHEN overall < 72 THEN 'fail' ELSE 'pass' END AS status
  FROM graded"""))
def heuristic_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select(
        "conv_id", "turn", F.round("evaluation.overall_score", 6).alias("overall"), "status")


_CRITERIA = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{n}' AS criterion, {v}::DOUBLE AS score, {i} AS n_issues FROM graded"
    for n, v, i in [
        ("completeness", "completeness", "CASE WHEN n_words > 200 THEN 0 ELSE 1 END"),
        ("factual_accuracy", "80", "0"), ("coherence", "70", "0"),
        ("actionability", "actionability", "CASE WHEN advice THEN 0 ELSE 1 END"),
        ("hallucination", "90", "0")])


@query(O.with_(O.REPORTS, O.CLEAN_MD, O.HEURISTIC, body=_CRITERIA))
def criteria(spark: SparkSession, d: str) -> DataFrame:
    return Q.explode_criteria(_graded(spark, d), ["conv_id", "turn"]).select(
        "conv_id", "turn", "criterion", "score", F.size("issues").alias("n_issues"))


@query(O.with_(O.REPORTS, O.CLEAN_MD, O.HEURISTIC, body="""SELECT conv_id, turn,
  CASE WHEN length(body) % 2 = 0 THEN (length(body) % 100)::DOUBLE ELSE round(overall, 6) END
  AS overall, CASE WHEN length(body) % 2 = 0 THEN n_words > 150 OR length(body) % 100 < 70
  ELSE overall < 70 END AS again FROM graded"""))
def parsed_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Fenced JSON answers for some texts, broken ones for the rest; then the decision rule."""
    n = F.length("body")
    answer = F.when(n % 2 == 0, F.format_string(
        '```json\n{"overall_score": %d, "should_regenerate": false, "checks": {"coherence": '
        '{"score": 50, "critical": %s}}, "issues": []}\n```',
        n % 100, (X.word_count(F.col("body")) > 150).cast("string"))).otherwise("invalid json {")
    rows = Q.evaluate_text(_clean_reports(_answers(spark, d)).withColumn("answer", answer), "body",
                           answer_col="answer")
    return rows.select("conv_id", "turn",
                       F.round("evaluation.overall_score", 6).alias("overall"),
                       Q.must_regenerate(F.col("evaluation")).alias("again"))


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    """The first answers of each chat as attempts at one report; later ones are cut early."""
    attempts = top_k(_answers(spark, d), 3, [F.col("turn")], ["conv_id"], "attempt")
    log = Q.evaluate_text(_clean_reports(attempts), "body", min_score=72.0).select(
        "conv_id", F.col("attempt").cast("long").alias("attempt"), F.col("evaluation.overall_score").alias("quality_score"),
        F.col("evaluation.should_regenerate").alias("should_regenerate"),
        (X.word_count(F.col("body")) / 1000).alias("writer_cost"), F.lit(0.25).alias("eval_cost"))
    return Q.select_attempt(log, "conv_id", cost_cols=["writer_cost", "eval_cost"], plan_cost=0.5)


_PLAYED_SQL = [O.REPORTS, O.CLEAN_MD, O.HEURISTIC, O.PLAYED]


@query(O.with_(*_PLAYED_SQL, body="""SELECT conv_id, chosen_attempt, round(score, 6)
  AS quality_score, attempts, final_status, round(total_cost, 6) AS total_cost FROM chosen"""))
def select_attempt(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d).select(
        "conv_id", "chosen_attempt", rounded("quality_score"), "attempts", "final_status",
        rounded("total_cost"))


@query(O.with_(*_PLAYED_SQL, body="""SELECT conv_id, attempt, round(score, 6) AS quality_score,
  CASE WHEN bad THEN 'fail' ELSE 'pass' END AS status, round(n_words / 1000 + 0.25, 6) AS cost
  FROM played"""))
def attempt_history(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d).select("conv_id", F.inline(F.transform(
        "history", lambda h: F.struct(
            h["attempt"].alias("attempt"), F.round(h["quality_score"], 6).alias("quality_score"),
            h["status"].alias("status"), F.round(h["cost"], 6).alias("cost")))))


@query(O.with_(*_PLAYED_SQL, body="""SELECT attempts, count(*) AS reports,
  count(*) FILTER (final_status = 'passed') AS passed,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM chosen GROUP BY attempts"""))
def attempt_statistics(spark: SparkSession, d: str) -> DataFrame:
    return Q.attempt_statistics(_chosen(spark, d)).withColumn("pct", F.round("pct", 6))


@query(O.with_(*_PLAYED_SQL, body="""SELECT count(*) AS reports, round(avg(attempts), 6)
  AS mean_attempts, round(avg(CASE WHEN final_status = 'passed' THEN 0.0 ELSE 1.0 END) * 100, 6)
  AS pct_max_attempts FROM chosen"""))
def attempt_overview(spark: SparkSession, d: str) -> DataFrame:
    return Q.attempt_overview(_chosen(spark, d)).select(
        "reports", rounded("mean_attempts"), rounded("pct_max_attempts"))


# --- I: accounting -----------------------------------------------------------------------------------


@query("""SELECT conv_id, role, sum(length(text) // 4)::BIGINT AS tokens FROM conversations
  GROUP BY 1, 2""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return chats(spark, d).groupBy("conv_id", "role").agg(
        F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


_PRICES = ", ".join(f"({O.quoted(m)}, {i}, {o})" for m, i, o in PRICES)
_OPUS, _SONNET = PRICES[3][0], PRICES[0][0]
_MODEL_SQL = f"""CASE role WHEN 'assistant' THEN {O.quoted(_OPUS)} WHEN 'user'
  THEN {O.quoted(_SONNET)} ELSE 'unlisted' END"""
_COSTED_SQL = f"""prices(model, pin, pout) AS (VALUES {_PRICES}),
calls AS (SELECT conv_id, turn, role, {_MODEL_SQL} AS model, length(text) // 4 AS tin,
  length(text) // 8 AS tout FROM conversations),
costed AS (SELECT conv_id, turn, role, tin / 1e6 * coalesce(pin, 3) + tout / 1e6 * coalesce(pout, 15)
  AS cost FROM calls LEFT JOIN prices USING (model))"""


def _costed(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("role") == "assistant", _OPUS).when(
        F.col("role") == "user", _SONNET).otherwise("unlisted")
    calls = chats(spark, d).select(
        "conv_id", "turn", "role", model.alias("model"),
        X.token_estimate(F.col("text")).alias("tin"), F.floor(F.length("text") / 8).alias("tout"))
    return A.token_cost(calls, "tin", "tout", "model")


@query(O.with_(_COSTED_SQL, body="SELECT conv_id, turn, round(cost, 9) AS cost FROM costed"))
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    return _costed(spark, d).select("conv_id", "turn", rounded("cost", 9))


@query(O.with_(_COSTED_SQL, body="""SELECT conv_id, role, count(*) AS calls,
  round(sum(cost), 9) AS cost, grouping(conv_id, role) AS level FROM costed
  GROUP BY ROLLUP (conv_id, role)"""))
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.cost_rollup(_costed(spark, d), ["conv_id", "role"]).withColumn(
        "cost", F.round("cost", 9))


@query(O.with_(_COSTED_SQL, body="""SELECT conv_id, stage, count(*) AS calls, round(sum(cost), 9) AS cost,
  round(avg(cost), 9) AS mean_cost, grouping(conv_id, stage) AS level
  FROM (SELECT *, CASE WHEN turn > 0 THEN role END AS stage FROM costed)
  GROUP BY GROUPING SETS ((conv_id, stage), (conv_id), (stage), ())"""))
def cost_by_report_and_stage(spark: SparkSession, d: str) -> DataFrame:
    """Costs of conversations, of stages (NULL for first turns), of both and in total, in one pass."""
    calls = _costed(spark, d).withColumn("stage", F.when(F.col("turn") > 0, F.col("role")))
    return A.cost_sets(calls, [["conv_id", "stage"], ["conv_id"], ["stage"], []]).withColumns(
        {c: F.round(c, 9) for c in ("cost", "mean_cost")})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return K.read_table(spark, d, "events")


def _worked():
    return F.col("event_type") != "error"


def _shown(value: str, digits: int) -> str:
    """SQL for rounding on the exact binary value, ties to even."""
    return f"format('{{:.{digits}f}}', {value})::DOUBLE"


@query(f"""SELECT user_id, count(*) AS total_calls, count(*) FILTER (event_type <> 'error')
  AS successful_calls, count(*) FILTER (event_type = 'error') AS failed_calls,
  {_shown("count(*) FILTER (event_type <> 'error') / count(*) * 100", 2)} AS success_rate,
  {_shown('sum(value)', 2)} AS total_time_seconds,
  {_shown('sum(value) / count(*)', 3)} AS average_time_seconds,
  {_shown('min(value)', 3)} AS min_time_seconds, {_shown('max(value)', 3)} AS max_time_seconds,
  arg_max(value, (ts, event_id)) AS last_execution_time, {_shown('sum(value)', 4)} AS total_cost,
  {_shown('sum(value) / count(*)', 6)} AS average_cost FROM events GROUP BY user_id""")
def call_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.call_metrics(_events(spark, d), "user_id", "value", _worked(), ["ts", "event_id"],
                          "value")


@query("""SELECT user_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  quantile_disc(value, 0.99) AS p99, count(*) AS calls, round(count(*) / sum(value), 6)
  AS calls_per_second, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate
  FROM events GROUP BY user_id""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.latency_percentiles(_events(spark, d), "user_id", "value", _worked()).select(
        "user_id", "p50", "p95", "p99", "calls", rounded("calls_per_second"),
        rounded("error_rate"))


@query("""SELECT n_distinct, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.95) AS p95,
  quantile_disc(x, 0.99) AS p99, count(*) AS calls FROM (SELECT l_extendedprice::DOUBLE AS x,
  'all' AS n_distinct FROM lineitem) GROUP BY 1""")
def percentiles_of_one_key(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of all prices: one key owns every row and spans many tasks."""
    prices = K.read_table(spark, d, "lineitem").select(
        F.lit("all").alias("n_distinct"), F.col("l_extendedprice").cast("double").alias("x"))
    return A.latency_percentiles(prices, "n_distinct", "x", F.lit(True)).select(
        "n_distinct", "p50", "p95", "p99", "calls")


@query("""SELECT rule, failing, checked FROM (SELECT count(*) AS checked,
  count(*) FILTER (NOT coalesce(value BETWEEN 0 AND 100, false)) AS a,
  count(*) FILTER (NOT coalesce(event_type IN ('click', 'view', 'purchase'), false)) AS b
  FROM events), LATERAL (VALUES ('value_range', a), ('known_type', b)) v(rule, failing)""")
def range_checks(spark: SparkSession, d: str) -> DataFrame:
    return A.range_checks(_events(spark, d), {
        "value_range": F.col("value").between(0, 100),
        "known_type": F.col("event_type").isin("click", "view", "purchase")})


@query(O.with_(*O.comments(), body=" UNION ALL ".join(
    f"SELECT '{r}' AS rule, 0::BIGINT AS failing, count(*) AS checked FROM kept"
    for r in A.RULE_NAMES)))
def score_bounds(spark: SparkSession, d: str) -> DataFrame:
    return A.range_checks(scored(spark, d), A.score_rules())


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS status,
  arg_max(value, (ts, event_id)) AS progress,
  arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS error,
  min(ts) AS started_at, max(ts) AS updated_at,
  max(ts) FILTER (event_type IN ('purchase', 'error')) AS completed_at
  FROM events GROUP BY user_id""")
def job_state(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d).withColumn(
        "error", F.when(F.col("event_type") == "error", F.col("props")))
    return A.latest_state(log, "user_id", ["ts", "event_id"],
                          {"status": "event_type", "progress": "value", "error": "error"},
                          "ts", "event_type", final=O.EVENT_TYPES_DONE)


@query(ORACLE["job_state"])
def job_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream whose batches come in the wrong order."""
    log = _events(spark, d).withColumn("error", F.when(F.col("event_type") == "error", F.col("props")))
    part = F.col("event_id") % 3
    return ST.feed([log.where(part == k) for k in (2, 0, 1)], lambda rows: A.latest_state(
        rows, "user_id", ["ts", "event_id"], {"status": "event_type", "progress": "value", "error": "error"},
        "ts", "event_type", final=O.EVENT_TYPES_DONE), f"{K.shared_folder(spark)}/stream-{uuid.uuid4().hex}", "complete")


#: Batches of events by their numbers: every 20th comes in the last one, whatever its time.
_BATCH = "CASE WHEN event_id % 20 = 7 THEN 3 ELSE least(2, floor(date_diff('hour', t0, ts) * 3 / span)) END"
_LATE_SQL = f"""bounds AS (SELECT min(ts) AS t0, date_diff('hour', min(ts), max(ts)) + 1 AS span FROM events),
dealt AS (SELECT event_type, ts, date_trunc('day', ts) AS window_start, {_BATCH} AS batch FROM events, bounds),
seen AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 2 DAY AS upto FROM dealt GROUP BY batch),
marks AS (SELECT batch, lag(upto) OVER (ORDER BY batch) AS mark, max(upto) OVER () AS last FROM seen)"""


@query(O.with_(_LATE_SQL, body="""SELECT window_start, event_type AS label, count(*) AS cnt
  FROM dealt JOIN marks USING (batch) WHERE (mark IS NULL OR window_start + INTERVAL 1 DAY > mark)
  AND window_start + INTERVAL 1 DAY <= last GROUP BY 1, 2"""))
def late_rows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts put out once a day is over by two days; rows that come after that are dropped."""
    events = _events(spark, d).select("event_id", "ts", "event_type")
    t0, t1 = events.agg(F.min("ts"), F.max("ts")).first()
    hour = F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.date_trunc("hour", F.lit(t0)))
    span = F.unix_timestamp(F.date_trunc("hour", F.lit(t1))) - F.unix_timestamp(F.date_trunc("hour", F.lit(t0))) + 3600
    batch = F.when(F.col("event_id") % 20 == 7, 3).otherwise(F.least(F.lit(2), F.floor(hour * 3 / span)))
    dealt = events.withColumn("batch", batch)
    zone = F.current_timezone()
    dealt = dealt.withColumn("ts", F.convert_timezone(F.lit("UTC"), zone, F.col("ts")).cast("timestamp"))
    out = ST.feed([dealt.where(F.col("batch") == k).drop("batch") for k in range(4)], lambda rows: ST.label_counts(
        rows, "ts", "event_type", "1 day", delay="2 days"), f"{K.shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.withColumn("window_start", F.convert_timezone(zone, F.lit("UTC"), F.col("window_start").cast("timestamp_ntz")))


@query("""SELECT count(DISTINCT text) AS texts, count(DISTINCT text) AS calls, count(*) AS rows,
  sum(length(text))::BIGINT AS chars FROM (SELECT coalesce(text, '') AS text FROM documents
  WHERE doc_id % 3 < 2 UNION ALL SELECT coalesce(text, '') FROM documents WHERE doc_id % 3 > 0)""")
def score_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over overlapping thirds share a table of scores: each different text is scored once."""
    folder = f"{K.shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    table = docs(spark, d).select("doc_id", "text")
    runs = [SC.cached_scores(table.where(part), "text", lambda t: t.withColumn("size", F.length("text")), folder, ["size"])
            for part in (F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 > 0)]
    both = runs[0].unionByName(runs[1]).agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))
    calls = spark.read.parquet(folder).agg(F.count_distinct("_key").alias("texts"), F.count("*").alias("calls"))
    return both.unionByName(calls, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("texts", "calls", "rows", "chars")])


@query("""SELECT count(DISTINCT user_id) AS jobs, count(DISTINCT event_type) AS uploads
  FROM events""")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).agg(F.count_distinct("user_id").alias("jobs"),
                                 F.count_distinct("event_type").alias("uploads"))


@query("""SELECT source, floor(count(*) * 1.5)::BIGINT AS seconds FROM documents
  GROUP BY source""")
def time_estimates(spark: SparkSession, d: str) -> DataFrame:
    return K.read_table(spark, d, "documents").groupBy("source").agg(
        A.time_estimate(F.count("*")).alias("seconds"))


# --- K: streams and periods (batch forms; the stream forms are tested for equality) ------------------


@query("""SELECT date_trunc('day', ts) AS window_start, event_type AS label, count(*) AS cnt
  FROM events GROUP BY ALL""")
def daily_labels(spark: SparkSession, d: str) -> DataFrame:
    return ST.label_counts(_events(spark, d), "ts", "event_type", "1 day")


@query("""SELECT date_trunc('day', ts) - to_days(k) AS window_start, event_type AS label,
  count(*) AS cnt FROM events, (VALUES (0), (1)) s(k) GROUP BY ALL""")
def sliding_labels(spark: SparkSession, d: str) -> DataFrame:
    return ST.label_counts(_events(spark, d), "ts", "event_type", "2 days", "1 day")


@query("""WITH c AS (SELECT date_trunc('week', ts) AS period, event_type AS label, count(*) AS cnt
  FROM events GROUP BY ALL), s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY period) AS share
  FROM c), p AS (SELECT DISTINCT period FROM s), a AS (SELECT period, label FROM s UNION
  SELECT p.period, label FROM s JOIN p ON p.period = s.period + INTERVAL 7 DAY)
  SELECT a.period, a.label, coalesce(n.cnt, 0) AS cnt, round(coalesce(n.share, 0), 6) AS share,
  CASE WHEN q.period IS NOT NULL THEN coalesce(n.cnt, 0) - coalesce(b.cnt, 0) END AS cnt_change,
  CASE WHEN q.period IS NOT NULL THEN round(coalesce(n.share, 0) - coalesce(b.share, 0), 6) END
  AS share_change FROM a LEFT JOIN s n ON n.period = a.period AND n.label = a.label
  LEFT JOIN s b ON b.period = a.period - INTERVAL 7 DAY AND b.label = a.label
  LEFT JOIN p q ON q.period = a.period - INTERVAL 7 DAY""")
def period_comparison(spark: SparkSession, d: str) -> DataFrame:
    return ST.period_comparison(_events(spark, d), "ts", "event_type").select(
        "period", "label", "cnt", rounded("share"), "cnt_change", rounded("share_change"))


@query(O.with_(O.DOCS, O.CLEANED, O.JUDGED, "kept AS (SELECT id, g, t FROM judged WHERE r0 IS NULL)",
               O.SCORED, O.TOPICS, body="""SELECT s.id AS doc_id, label, emotion,
  topic AS primary_topic FROM scored s JOIN topics t ON t.id = s.id AND rn = 1"""))
def stream_clean_and_score(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream, run to its end into a table."""
    folder = f"{K.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/documents.parquet"
    # As a pattern, the path may name one file or a folder of files.
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    stream = ST.clean_and_score(source.select("doc_id", "text"), "text").select(
        "doc_id", "sentiment.label", "emotion.emotion", "topics.primary_topic")
    run = (stream.writeStream.format("parquet").option("path", f"{folder}/out")
           .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# --- the whole analysis ---------------------------------------------------------------------------------


@query(O.with_(*GATE_SQL, body="""SELECT round(sum(score * weight) / sum(weight), 6)
  AS quality_score, any_value((SELECT count(*) FROM kept)) AS comments,
  any_value((SELECT topic FROM topic_top WHERE rank = 1)) AS first_topic,
  any_value((SELECT txt FROM entity_top WHERE rank = 1)) AS first_entity
  FROM checks JOIN weights USING (name)"""))
def full_analysis(spark: SparkSession, d: str) -> DataFrame:
    a = analyse(K.read_table(spark, d, "documents"), "text", "doc_id")
    first = a.topics.where("rank = 1").select(F.col("topic").alias("first_topic"))
    entity = a.entities.where("rank = 1").select(F.col("text").alias("first_entity"))
    return a.verdict.select(
        rounded("quality_score"), a.comments.agg(F.count("*")).scalar().alias("comments"),
        first.scalar().alias("first_topic"), entity.scalar().alias("first_entity"))
