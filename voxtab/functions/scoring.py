"""Per-comment scores as Column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtab.constants import (
    BAND_EDGE,
    CAPITALISED_RUN,
    DEFAULT_TOPIC,
    EMOTION_WORDS,
    EMOTIONS,
    ENTITY_RULES,
    HIT_LOGIT,
    NEGATIVE_WORDS,
    NEUTRAL_LOGIT,
    POSITIVE_WORDS,
    SENTIMENT_VALUES,
    SENTIMENTS,
    TOPIC_MIN_LENGTH,
    TOPIC_STOP_WORDS,
    TOPIC_STRIP,
    TOPICS_PER_COMMENT,
)
from voxtab.functions.text import words
from voxtab.functions.values import argmax, let, softmax
from voxtab.schemas import EMOTION, KEYPHRASES, SENTIMENT, SPANS


def _labelled(label: str, score: str, labels: list[str], logits: Column) -> Column:
    names = F.array(*[F.lit(n) for n in labels])
    return let(
        softmax(logits),
        lambda p: F.struct(
            argmax(labels, p).alias(label),
            F.array_max(p).alias(score),
            F.map_from_arrays(names, p).alias("scores"),
        ),
    )


def _hits(text: Column, vocabulary: Sequence[str]) -> Column:
    """Words of the text that are in the vocabulary, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*vocabulary))


def _count(hits: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(hits, lambda w: w.isin(*vocabulary))).cast("double")


def sentiment_of_hits(
    hits: Column,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """struct(label, score, scores) of the lexicon words of a text; none gives neutral."""

    def body(h: Column) -> Column:
        net = _count(h, positive) - _count(h, negative)
        logits = F.array(net * -HIT_LOGIT, F.lit(NEUTRAL_LOGIT), net * HIT_LOGIT)
        return _labelled("label", "score", SENTIMENTS, logits)

    return let(hits, body).cast(SENTIMENT)


def emotion_of_hits(hits: Column, lexicon: dict[str, Sequence[str]] = EMOTION_WORDS) -> Column:
    """struct(emotion, confidence, scores) over the seven classes."""

    def body(h: Column) -> Column:
        logits = F.array(*[
            _count(h, lexicon[e]) * HIT_LOGIT if e in lexicon else F.lit(NEUTRAL_LOGIT)
            for e in EMOTIONS
        ])
        return _labelled("emotion", "confidence", EMOTIONS, logits)

    return let(hits, body).cast(EMOTION)


FROM_HITS = {"sentiment": sentiment_of_hits, "emotion": emotion_of_hits}


def lexicon_hits(text: Column) -> Column:
    """Words of the text that the default lexicons know: one pass serves both scorers."""
    emotional = {w for ws in EMOTION_WORDS.values() for w in ws}
    return _hits(text, sorted({*POSITIVE_WORDS, *NEGATIVE_WORDS, *emotional}))


def sentiment(text: Column, positive: Sequence[str] = POSITIVE_WORDS,
              negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    return sentiment_of_hits(_hits(text, [*positive, *negative]), positive, negative)


def emotion(text: Column, lexicon: dict[str, Sequence[str]] = EMOTION_WORDS) -> Column:
    every = sorted({w for ws in lexicon.values() for w in ws})
    return emotion_of_hits(_hits(text, every), lexicon)


def topic_tokens(text: Column) -> Column:
    """Lower-case tokens long enough and not stop words, stripped after those tests."""
    kept = F.filter(
        words(F.lower(text)),
        lambda w: (F.length(w) > TOPIC_MIN_LENGTH) & ~w.isin(*TOPIC_STOP_WORDS),
    )
    return F.transform(kept, lambda w: F.btrim(w, F.lit(TOPIC_STRIP)))


def topic_list(text: Column) -> Column:
    first = F.slice(F.array_distinct(topic_tokens(text)), 1, TOPICS_PER_COMMENT)
    return let(first, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(DEFAULT_TOPIC))))


def topics(text: Column) -> Column:
    """struct(topics, relevance_scores, primary_topic); relevance is 1/rank."""
    return let(
        topic_list(text),
        lambda t: F.struct(
            t.alias("topics"),
            F.map_from_arrays(
                t, F.transform(t, lambda _, i: F.lit(1.0) / (i + 1))
            ).alias("relevance_scores"),
            t[0].alias("primary_topic"),
        ),
    )


def find_spans(text: Column, pattern: str, kind: str, confidence: float,
               marks: Sequence[str] = ()) -> Column:
    """Every match of a pattern as array of struct(text, type, start, end, confidence).

    Texts without any of ``marks`` are not searched at all. Matches are fenced by two noncharacters, the text is cut at the fences, and a
    fold over the pieces (every second one is a match) adds up the offsets.
    """
    fences = "\ufdd0\ufdd1"
    fenced = F.regexp_replace(F.translate(text, fences, "  "), f"({pattern})", "\ufdd0$1\ufdd1")
    none = F.array().cast(SPANS)

    def step(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        span = F.struct(
            piece.alias("text"), F.lit(kind).alias("type"), a["at"].alias("start"),
            end.alias("end"), F.lit(confidence).alias("confidence"),
        )
        return F.struct(
            end.alias("at"),
            (~a["hit"]).alias("hit"),
            F.when(a["hit"], F.concat(a["found"], F.array(span))).otherwise(a["found"])
            .cast(SPANS).alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("found"))
    found = F.aggregate(F.split(fenced, f"[{fences}]"), start, step, lambda a: a["found"])
    if not marks:
        return found
    worth = F.lit(False)
    for mark in marks:
        worth = worth | F.contains(text, F.lit(mark))
    return F.when(worth, found).otherwise(none)


def without_overlap(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of those already taken."""
    return F.filter(spans, lambda s: ~F.exists(
        taken, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])))


def rule_entities(text: Column) -> Column:
    """E-mail, URL, money and date spans; an earlier rule keeps its span."""
    found = F.array().cast(SPANS)
    for kind, marks, pattern, confidence in ENTITY_RULES:
        found = let(
            F.struct(found.alias("old"),
                     find_spans(text, pattern, kind, confidence, marks).alias("new")),
            lambda p: F.concat(p["old"], without_overlap(p["new"], p["old"])),
        )
    return found


def capitalised_runs(text: Column) -> Column:
    kind, pattern, confidence = CAPITALISED_RUN
    return find_spans(text, pattern, kind, confidence)


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: a["start"] - b["start"])


def entities(text: Column) -> Column:
    """All rule entities and capitalised runs, in order of position (no gazetteer)."""
    both = let(
        F.struct(rule_entities(text).alias("rules"), capitalised_runs(text).alias("runs")),
        lambda p: F.concat(p["rules"], without_overlap(p["runs"], p["rules"])),
    )
    return by_start(both)


def no_emotion() -> Column:
    """What a comment gets when the emotion scorer is off."""
    return F.struct(
        F.lit("neutral").alias("emotion"),
        F.lit(0.0).alias("confidence"),
        F.create_map(F.lit("neutral"), F.lit(1.0)).alias("scores"),
    ).cast(EMOTION)


def no_keyphrases() -> Column:
    """What a comment gets when the keyphrase scorer is off."""
    return F.struct(
        F.array().cast("array<string>").alias("keyphrases"),
        F.create_map().cast("map<string,double>").alias("scores"),
    ).cast(KEYPHRASES)


def sentiment_value(label: Column) -> Column:
    value = F.lit(0.0)
    for name, number in SENTIMENT_VALUES.items():
        value = F.when(label == name, number).otherwise(value)
    return value


def sentiment_band(value: Column) -> Column:
    return (
        F.when(value > BAND_EDGE, "positive").when(value < -BAND_EDGE, "negative")
        .otherwise("neutral")
    )
