"""Small building blocks for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def compute_once(value: Column) -> Column:
    """Keep a costly expression in its own projection.

    Catalyst moves a filter below a projection by copying the projected expression
    into it, once per mention, so a filter on cleaned text would clean the text
    many times over. A partition id makes the expression non-deterministic in
    name only, and such projections are neither copied nor merged.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def py_round(x: Column, digits: int) -> Column:
    """Round as Python does: on the exact binary value, ties to even (digits <= 6).

    Spark's ``round`` and ``format_string`` round the shortest decimal form half
    up, so 6.25 would print as 6.3. The product ``x * 10**digits`` is split into
    its double and the exact error of that double, which decides near ties.
    """
    scale = float(10**digits)

    def body(v: Column) -> Column:
        big = v * F.lit(134217729.0)
        high = big - (big - v)
        product = v * F.lit(scale)
        error = (high * F.lit(scale) - product) + (v - high) * F.lit(scale)
        down = F.floor(product)
        rest = product - down
        tie_up = (error > 0) | ((error == 0) & (down % 2 != 0))
        up = (rest > 0.5) | ((rest == 0.5) & tie_up)
        return (down + F.when(up, 1).otherwise(0)) / F.lit(scale)

    return let(x.cast("double"), body)


def fixed(x: Column, digits: int) -> Column:
    """Text of ``x`` with a fixed number of decimals, as Python's ``f"{x:.nf}"``."""
    return F.format_string(f"%.{digits}f", py_round(x, digits))


def finite_or_null(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; shifted by the maximum so it cannot overflow."""
    return let(
        let(logits, lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)))),
        lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda a, v: a + v),
            lambda total: F.transform(e, lambda v: v / total),
        ),
    )


def argmax(labels: list[str], scores: Column) -> Column:
    """Label of the largest score; the first one wins a tie."""
    names = F.array(*[F.lit(n) for n in labels])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
