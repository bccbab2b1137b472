"""Markdown and JSON text helpers for reports and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtab.functions.text import SPACE, py_strip
from voxtab.functions.values import let


def clean_markdown(c: Column) -> Column:
    """Trim, drop an enclosing code fence, space out headers, squeeze blank lines."""

    def unfence(t: Column) -> Column:
        def drop(opening: str) -> Column:
            return F.regexp_replace(F.regexp_replace(t, opening, ""), r"\n```\z", "")

        return (
            F.when(F.startswith(t, F.lit("```markdown")), drop("\\A```markdown\n"))
            .when(F.startswith(t, F.lit("```")), drop("\\A```\n"))
            .otherwise(t)
        )

    body = let(py_strip(c), unfence)
    spaced = F.regexp_replace(body, rf"(?U)(#{{1,6}}{SPACE}+[^\n]+)\n([^\n#])", "$1\n\n$2")
    return py_strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def section_headings(c: Column) -> Column:
    """Titles of the ## and ### headers, in order, without bold marks."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(rf"(?U)\A#{{2,3}}{SPACE}+[^\n]"))
    titles = F.transform(lines, lambda x: py_strip(
        F.regexp_replace(x, rf"(?U)\A#{{2,3}}{SPACE}+", "")))
    return F.transform(titles, lambda x: F.replace(
        F.replace(x, F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))


def strip_fence(c: Column) -> Column:
    """Without the first and last line if the trimmed text starts with a code fence."""
    return let(py_strip(c), lambda t: F.when(
        F.startswith(t, F.lit("```")),
        F.array_join(let(F.split(t, "\n"), lambda x: F.slice(
            x, 2, F.greatest(F.size(x) - 2, F.lit(0)))), "\n"),
    ).otherwise(t))
