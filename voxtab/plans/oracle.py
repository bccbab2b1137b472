"""SQL pieces from which the checking queries are put together (DuckDB dialect)."""

from __future__ import annotations

from voxtab.constants import (
    EMOTION_WORDS,
    EMOTIONS,
    ENGLISH_WORDS,
    GATE_CHECKS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    SPAM_PATTERNS,
    TEXT_COLUMN_KEYWORDS,
    TOPIC_STOP_WORDS,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- comments: (id, g, raw) --------------------------------------------------------

DOCS = "src AS (SELECT doc_id AS id, source AS g, lang, text AS raw FROM documents)"
PAGES = "src AS (SELECT page_id AS id, '' AS g, html AS raw FROM pages)"
CHATS = ("src AS (SELECT conv_id * 1000 + turn AS id, role AS g, text AS raw "
         "FROM conversations)")

_SPAM = " OR ".join(f"regexp_matches(lower(t), {quoted(p)})" for p in SPAM_PATTERNS)

CLEANED = r"""cleaned AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(raw,
  '<[^>]+>', '', 'g'), 'http\S+|www\.\S+', '', 'g'), '\s+', ' ', 'g')) AS t FROM src)"""

JUDGED = rf"""judged AS (SELECT *, CASE WHEN raw IS NULL THEN 'missing' WHEN t = '' THEN 'empty'
  WHEN length(t) < 3 THEN 'short'
  WHEN {_SPAM} OR (length(t) > 10
    AND length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) / length(t) > 0.7) THEN 'spam'
  END AS r0 FROM cleaned)"""


def marked(by_group: bool = False) -> str:
    part = "g, t, r0" if by_group else "t, r0"
    return f"""marked AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0
  WHEN row_number() OVER (PARTITION BY {part} ORDER BY id) > 1 THEN 'duplicate'
  END AS reason FROM judged)"""


KEPT = "kept AS (SELECT id, g, t FROM marked WHERE reason IS NULL)"


def comments(source: str = DOCS, by_group: bool = False) -> list[str]:
    return [source, CLEANED, JUDGED, marked(by_group), KEPT]


# --- scores -----------------------------------------------------------------------------


def _hits(words) -> str:
    return f"len(list_filter(w, lambda x: x IN ({listed(words)})))"


_EMO_LOGITS = ", ".join(
    f"4.0 * {_hits(EMOTION_WORDS[e])}" if e in EMOTION_WORDS else "2.0" for e in EMOTIONS)

SCORED = f"""tokens AS (SELECT *, string_split_regex(lower(t), '[^a-z]+') AS w FROM kept),
logits AS (SELECT id, g, t,
  [4.0 * ({_hits(NEGATIVE_WORDS)} - {_hits(POSITIVE_WORDS)}), 2.0,
   4.0 * ({_hits(POSITIVE_WORDS)} - {_hits(NEGATIVE_WORDS)})] AS sl,
  [{_EMO_LOGITS}] AS el FROM tokens),
scored AS (SELECT id, g, t,
  list_extract(['negative', 'neutral', 'positive'], list_position(sl, list_max(sl))) AS label,
  1.0 / list_sum(list_transform(sl, lambda x: exp(x - list_max(sl)))) AS score,
  list_transform(sl, lambda x: exp(x - list_max(sl))) AS se,
  list_extract([{listed(EMOTIONS)}], list_position(el, list_max(el))) AS emotion,
  1.0 / list_sum(list_transform(el, lambda x: exp(x - list_max(el)))) AS confidence,
  list_transform(el, lambda x: exp(x - list_max(el))) AS ee FROM logits),
valued AS (SELECT *, CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END
  AS v FROM scored)"""

_STRIP = """regexp_replace(wd, '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g')"""

TOPICS = f"""topic_words AS (SELECT id, unnest(string_split(lower(t), ' ')) AS wd,
  generate_subscripts(string_split(lower(t), ' '), 1) AS p FROM kept),
topic_first AS (SELECT id, {_STRIP} AS topic, min(p) AS p FROM topic_words
  WHERE length(wd) > 4 AND wd NOT IN ({listed(TOPIC_STOP_WORDS)}) GROUP BY 1, 2),
topic_all AS (SELECT id, topic, row_number() OVER (PARTITION BY id ORDER BY p) AS rn
  FROM topic_first),
topics AS (SELECT id, topic, rn FROM topic_all WHERE rn <= 5
  UNION ALL SELECT id, 'general', 1 FROM kept WHERE id NOT IN (SELECT id FROM topic_first))"""

_PHRASE_TOKENS = f"""grams_of AS (SELECT id, {_STRIP} AS tok,
  row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS i FROM topic_words
  WHERE length(wd) > 4 AND wd NOT IN ({listed(TOPIC_STOP_WORDS)}))"""

# needs TOPICS
PHRASES = f"""{_PHRASE_TOKENS},
pairs AS (SELECT id, tok, i, lead(tok) OVER (PARTITION BY id ORDER BY i) AS nxt FROM grams_of),
grams AS (SELECT id, trim(tok) AS phrase, 2 * i AS pos FROM pairs
  UNION ALL SELECT id, trim(tok || ' ' || nxt), 2 * i + 1 FROM pairs WHERE nxt IS NOT NULL),
tf AS (SELECT id, phrase, count(*) AS tf, min(pos) AS pos FROM grams WHERE length(phrase) > 2
  GROUP BY 1, 2),
dfs AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
weighed AS (SELECT id, phrase, pos, tf * ln(1.0 + (SELECT count(*) FROM kept) / df) AS raw
  FROM tf JOIN dfs USING (phrase)),
phrases AS (SELECT * FROM (SELECT id, phrase, raw / max(raw) OVER (PARTITION BY id) AS score,
  row_number() OVER (PARTITION BY id ORDER BY raw DESC, pos) AS rank FROM weighed))"""

_EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_URL = r"(https?://[^\s<>\"]+|www\.[^\s<>\"]+)"
_MONEY = r"([$€£]\s?\d[\d,]*(?:\.\d+)?)"
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"
_RUNS = r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"


def _spans(kind: str, prio: int, pattern: str, confidence: float, column: str = "t",
           replacement: str = r"chr(1) || '\1' || chr(2)") -> str:
    fenced = f"regexp_replace({column}, {quoted(pattern)}, {replacement}, 'g')"
    return f"""SELECT id, {prio} AS prio, {quoted(kind)} AS kind, {confidence} AS confidence, txt,
  CAST(e - length(txt) AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (
  SELECT id, txt, i, sum(length(txt)) OVER (PARTITION BY id ORDER BY i) AS e FROM (
    SELECT id, unnest(p) AS txt, generate_subscripts(p, 1) AS i FROM (
      SELECT id, string_split_regex({fenced}, '[\\x01\\x02]') AS p FROM kept))) WHERE i % 2 = 0"""


def entities(names: dict[str, str] | None = None) -> str:
    """CTE ``ents``: spans by rule order, minus those overlapping an earlier rule's."""
    rules = [("EMAIL", _EMAIL, 1.0, {}), ("URL", _URL, 1.0, {}), ("MONEY", _MONEY, 1.0, {}),
             ("DATE", _DATE, 1.0, {})]
    both = r"'\1' || chr(1) || '\2' || chr(2)"
    if names:
        for i, (name, kind) in enumerate(names.items()):
            rules.append((kind, rf"\b({name})\b", 0.9, {}))
    rules.append(("MISC", _RUNS, 0.5, {"replacement": both}))
    spans = " UNION ALL ".join(
        f"({_spans(k, min(i, 4) if i < len(rules) - 1 else 5, p, c, **kw)})"
        for i, (k, p, c, kw) in enumerate(rules))
    ctes = [f"spans AS ({spans})", "e0 AS (SELECT * FROM spans WHERE prio = 0)"]
    for level in range(1, 6):
        ctes.append(
            f"e{level} AS (SELECT * FROM e{level - 1} UNION ALL SELECT * FROM spans a WHERE "
            f"prio = {level} AND NOT EXISTS (SELECT 1 FROM e{level - 1} b WHERE b.id = a.id "
            "AND b.s < a.e AND a.s < b.e))")
    ctes.append("""ents AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS pos
  FROM e5)""")
    return ",\n".join(ctes)


# --- summaries (need TOPICS / entities() / PHRASES and SCORED) -----------------------------


def topic_summary(by_group: bool = False) -> str:
    key, part = ("g, topic", "PARTITION BY g ") if by_group else ("topic", "")
    return f"""topic_counts AS (SELECT {key}, count(*) AS cnt, avg(v) AS avg_sentiment,
  min(id * 3 + rn - 1) AS first FROM topics JOIN valued USING (id) WHERE rn <= 3 GROUP BY {key}),
topic_top AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY cnt DESC, first) AS rank
  FROM topic_counts) WHERE rank <= 10)"""


ENTITY_TOP = """entity_counts AS (SELECT txt, kind, count(*) AS cnt, avg(v) AS sentiment,
  min(id * 1000000 + pos) AS first FROM ents JOIN valued USING (id) GROUP BY 1, 2),
entity_top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, first) AS rank
  FROM entity_counts) WHERE rank <= 20)"""

PHRASE_TOP = """phrase_top AS (SELECT * FROM (SELECT *, row_number() OVER
  (ORDER BY cnt DESC, first) AS rank FROM (SELECT phrase, count(*) AS cnt,
  min(id * 3 + rank - 1) AS first FROM phrases WHERE rank <= 3 GROUP BY 1)) WHERE rank <= 20)"""

#: The same with counts, weights and ranks inside each group.
GROUP_PHRASE_TOP = """group_dfs AS (SELECT g, phrase, count(*) AS df FROM tf JOIN kept USING (id) GROUP BY ALL),
group_rows AS (SELECT g, count(*) AS n FROM kept GROUP BY g),
group_weighed AS (SELECT id, tf.phrase, pos, kept.g AS g, tf * ln(1.0 + n / df) AS raw FROM tf JOIN kept USING (id)
  JOIN group_dfs d ON d.phrase = tf.phrase AND d.g IS NOT DISTINCT FROM kept.g
  JOIN group_rows r ON r.g IS NOT DISTINCT FROM kept.g),
group_phrases AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY raw DESC, pos) AS rank FROM group_weighed),
group_phrase_top AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY g ORDER BY cnt DESC, first) AS rank FROM (SELECT g, phrase, count(*) AS cnt,
  min(id * 3 + rank - 1) AS first FROM group_phrases WHERE rank <= 3 GROUP BY 1, 2)) WHERE rank <= 20)"""

# --- quality gate (needs SCORED, topic_summary, ENTITY_TOP) ------------------------------------

_WEIGHTS = ", ".join(f"({quoted(n)}, {w}, {o})" for n, w, o, _, _ in GATE_CHECKS)

GATE = f"""facts AS (SELECT (SELECT count(*) FROM kept) AS total,
  (SELECT count(*) FROM scored) AS processed,
  (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM scored GROUP BY label)) AS share,
  (SELECT count(*) FROM topic_top) AS nt, (SELECT avg(cnt) FROM topic_top) AS tc,
  (SELECT count(*) FROM entity_top) AS ne,
  (SELECT (avg(score) + avg(confidence) FILTER (confidence > 0)) / 2 FROM scored) AS conf),
checks AS (
  SELECT 1 AS check_order, 'Data Coverage' AS name, processed / total >= 0.8 AS passed,
    processed / total * 100 AS score FROM facts
  UNION ALL SELECT 2, 'Sentiment Quality', share < 0.9,
    CASE WHEN share < 0.5 THEN 100 WHEN share < 0.7 THEN 80 WHEN share < 0.9 THEN 60 ELSE 40 END
    FROM facts
  UNION ALL SELECT 3, 'Topic Quality', nt >= 2, CASE WHEN nt = 0 THEN 0
    WHEN nt >= 5 AND tc / total > 0.3 THEN 90 WHEN nt >= 3 AND tc / total > 0.2 THEN 75
    WHEN nt >= 2 THEN 60 ELSE 40 END FROM facts
  UNION ALL SELECT 4, 'Entity Quality', ne >= 1, CASE WHEN ne >= 10 THEN 90 WHEN ne >= 5 THEN 75
    WHEN ne >= 2 THEN 60 WHEN ne >= 1 THEN 50 ELSE 30 END FROM facts
  UNION ALL SELECT 5, 'Confidence Check', conf >= 0.6, conf * 100 FROM facts),
weights(name, weight, o) AS (VALUES {_WEIGHTS})"""

# --- column profile ---------------------------------------------------------------------------

PROFILED = {
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"], []),
    "pages": ("page_id", ["page_id", "url", "html"], []),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"], []),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal",
                               "c_mktsegment"], []),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                              "o_orderdate", "o_orderpriority"], ["o_orderdate"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size",
                           "p_retailprice"], []),
}


def heads() -> str:
    """CTE ``heads``: tbl, position, col, nr, value of the first 100 non-null values."""
    parts = []
    for table, (key, columns, days) in PROFILED.items():
        for i, c in enumerate(columns):
            value = f"strftime({c}, '%Y-%m-%d')" if c in days else f"CAST({c} AS VARCHAR)"
            parts.append(
                f"SELECT '{table}' AS tbl, {i} AS position, '{c}' AS col, nr, value FROM (SELECT "
                f"row_number() OVER (ORDER BY {key}) AS nr, {value} AS value FROM {table} "
                f"WHERE {c} IS NOT NULL) WHERE nr <= 100")
    return "heads AS (" + "\nUNION ALL ".join(parts) + ")"


_NAMED = " OR ".join(f"lower(col) LIKE '%{k}%'" for k in TEXT_COLUMN_KEYWORDS)

COLUMN_SCORES = f"""col_stats AS (SELECT tbl, position, col, avg(length(value)) AS len,
  avg(CASE WHEN value LIKE '% %' THEN 1.0 ELSE 0.0 END) AS sp FROM heads GROUP BY 1, 2, 3),
col_parts AS (SELECT *, CASE WHEN {_NAMED} THEN 0.5 ELSE 0.0 END AS ns,
  CASE WHEN len > 50 THEN 0.3 WHEN len > 20 THEN 0.2 WHEN len > 10 THEN 0.1 ELSE 0.0 END AS ls,
  CASE WHEN sp > 0.7 THEN 0.2 WHEN sp > 0.3 THEN 0.1 ELSE 0.0 END AS ss FROM col_stats),
col_scores AS (SELECT *, least(ns + ls + ss, 1.0) AS confidence FROM col_parts)"""

# --- reports: Markdown texts made from all turns ----------------------------------------------

REPORTS = r"""reports AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
  AS attempt, '  ```markdown' || chr(10) || '# Conversation ' || conv_id || chr(10) || '## **Turn '
  || turn || '**' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10)
  || '### Next __steps__' || chr(10) || CASE WHEN length(text) > 400 THEN 'We recommend more.'
  ELSE 'None.' END || chr(10) || '```' || chr(10) AS md FROM conversations)"""

CLEAN_MD = r"""clean_md AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(md, ' ' || chr(9) || chr(10) || chr(13)), '^```markdown\n', ''), '\n```$', ''),
  '(#{1,6}\s+[^\n]+)\n([^\n#])', '\1' || chr(10) || chr(10) || '\2', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM reports)"""

HEURISTIC = r"""facts_md AS (SELECT *, len(list_filter(string_split_regex(body, '\s+'),
  lambda x: x <> '')) AS n_words, contains(body, '##') AS heads,
  contains(lower(body), 'recommend') AS advice FROM clean_md),
parts_md AS (SELECT *, 50.0::DOUBLE + CASE WHEN n_words > 200 THEN 15 ELSE 0 END
  + CASE WHEN heads THEN 15 ELSE 0 END + CASE WHEN advice THEN 10 ELSE 0 END AS completeness,
  CASE WHEN advice THEN 60.0 ELSE 40.0 END AS actionability FROM facts_md),
graded AS (SELECT *, completeness * 0.30::DOUBLE + 80 * 0.25::DOUBLE + 70 * 0.20::DOUBLE
  + actionability * 0.15::DOUBLE + 90 * 0.10::DOUBLE AS overall FROM parts_md)"""

PLAYED = """flags AS (SELECT conv_id, attempt, overall AS score, overall < 72 AS bad, n_words
  FROM graded WHERE attempt <= 3),
played AS (SELECT * FROM (SELECT *, min(CASE WHEN NOT bad THEN attempt END)
  OVER (PARTITION BY conv_id) AS first_ok FROM flags) WHERE first_ok IS NULL
  OR attempt <= first_ok),
chosen AS (SELECT conv_id, max(attempt) AS chosen_attempt, arg_max(score, attempt) AS score,
  count(*) AS attempts, CASE WHEN max(first_ok) IS NOT NULL THEN 'passed'
  ELSE 'max_attempts_reached' END AS final_status,
  0.5 + sum(n_words / 1000 + 0.25) AS total_cost FROM played GROUP BY conv_id)"""

EVENT_TYPES_DONE = ["purchase", "error"]
ENGLISH = "|".join(ENGLISH_WORDS)
