"""Cleaning expressions. Whitespace follows Python's str rules (Unicode and 0x1c-0x1f)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtab.constants import (
    ENGLISH_WORDS,
    MIN_TEXT_LENGTH,
    SHOUT_MIN_LENGTH,
    SHOUT_SHARE,
    SPAM_PATTERNS,
)
from voxtab.functions.values import let

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
ODD_SPACE = r"[\s\x1c-\x1f&&[^ ]]"

# How each spam pattern is tested: texts of which every group must supply one (a
# byte search that settles most rows), then a regex where those alone do not decide.
# The anchored forms are linear: the first keyword and the first space after it
# leave the longest tail, so no later one can succeed where they fail.
SPAM_TESTS = {
    r"(buy|click|visit|check)\s+(now|here|this)": (
        [["buy", "click", "visit", "check"], ["now", "here", "this"]],
        r"(buy|click|visit|check)\s+(now|here|this)"),
    r"http.*\s.*http": ([["http"]], r"^(?>.*?http)(?>.*?\s).*http"),
    r"(!!!){2,}": ([["!!!!!!"]], None),
    r"(\$\$\$|€€€|£££)": ([["$$$", "€€€", "£££"]], None),
    r"(free|win|winner|prize).*now": (
        [["free", "win", "prize"], ["now"]], r"^(?>.*?(?:free|win|prize)).*now"),
    r"(viagra|cialis|pharmacy)": ([["viagra", "cialis", "pharmacy"]], None),
}


def has_any(c: Column, texts: Sequence[str]) -> Column:
    out = F.contains(c, F.lit(texts[0]))
    for text in texts[1:]:
        out = out | F.contains(c, F.lit(text))
    return out


def strip_html(c: Column) -> Column:
    # Past the last ">" no tag can close; leaving that tail out keeps this linear.
    tail = F.coalesce(F.nullif(F.instr(F.reverse(c), ">"), F.lit(0)) - 1, F.length(c))
    cut = F.length(c) - tail
    head = F.regexp_replace(F.substring(c, F.lit(1), cut), "<[^>]+>", "")
    return F.when(has_any(c, ["<"]),
                  F.concat(head, F.substring(c, cut + 1, F.length(c)))).otherwise(c)


def strip_urls(c: Column) -> Column:
    pattern = rf"(?U)http{NOT_SPACE}+|www\.{NOT_SPACE}+"
    return F.when(has_any(c, ["http", "www."]), F.regexp_replace(c, pattern, "")).otherwise(c)


def squeeze_spaces(c: Column) -> Column:
    # Only runs that are not one plain space already are matched and replaced.
    return F.trim(F.regexp_replace(c, rf"(?U) ?{ODD_SPACE}{SPACE}*|  {SPACE}*", " "))


def clean_text(c: Column) -> Column:
    """Tags out, then URLs, then runs of whitespace to one space, then trim."""
    return squeeze_spaces(let(strip_html(c), strip_urls))


def spam_patterns(clean: Column) -> Column:
    """True where any spam pattern is found, in any case (long s and dotless i included)."""

    def found(low: Column) -> Column:
        out = F.lit(False)
        for pattern in SPAM_PATTERNS:
            groups, regex = SPAM_TESTS[pattern]
            hit = has_any(low, groups[0])
            for group in groups[1:]:
                hit = hit & has_any(low, group)
            out = out | (hit & low.rlike(regex) if regex else hit)
        return out

    def plain(low: Column) -> Column:
        return F.when(has_any(low, ["ſ", "ı"]), F.translate(low, "ſı", "si")).otherwise(low)

    return let(let(F.lower(clean), plain), found)


def is_shouting(clean: Column) -> Column:
    """More than 70 % capitals, over all characters, in texts longer than 10."""
    others = F.length(F.regexp_replace(clean, r"\p{IsUppercase}+", ""))
    capitals = F.length(clean) - others
    return (F.length(clean) > SHOUT_MIN_LENGTH) & (capitals / F.length(clean) > SHOUT_SHARE)


def is_spam(clean: Column) -> Column:
    return spam_patterns(clean) | is_shouting(clean)


def removal_reason(raw: Column, clean: Column) -> Column:
    """First reason to drop a row on its own merits; NULL for a keepable row."""
    return (
        F.when(raw.isNull(), "missing")
        .when(clean == "", "empty")
        .when(F.length(clean) < MIN_TEXT_LENGTH, "short")
        .when(is_spam(clean), "spam")
    )


def text_key(clean: Column) -> Column:
    """32-byte digest used instead of whole texts wherever texts are grouped or joined."""
    return F.unhex(F.sha2(clean, 256))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Whitespace-separated tokens: runs of other characters."""
    return F.size(words(c)).cast("long")


def has_english_word(c: Column) -> Column:
    """True where any of the common English words occurs as a substring."""
    return F.lower(c).rlike("|".join(ENGLISH_WORDS))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def py_strip(c: Column) -> Column:
    """Strip whitespace at both ends by Python's rules."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")
