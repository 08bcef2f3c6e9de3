"""Numeric column expressions: guarded ratios, parsing, intervals, interpolation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions import contract

# Fixed pattern: the decimal texts accepted as a number (underscores between digits,
# exponents and the words for non-finite values included; suffixes such as 1d are not).
# No part can end in two ways, so none is ever tried again.
_DIGITS = r"\d++(?:_\d++)*+"
NUMBER_TEXT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?+)?+|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?+$"
INFINITE_TEXT = r"(?i)^[+-]?inf(inity)?$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def harmonic(precision: Column, recall: Column) -> Column:
    """F1 of two rates; 0 when either is null or 0."""
    return F.when((precision > 0) & (recall > 0),
                  2 * precision * recall / (precision + recall)).otherwise(0.0)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def finite(value: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    number = value.cast("double")
    return F.when(is_finite(number), number)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def number_in(text: Column) -> Column:
    """The number a trimmed text stands for, infinite if it is too large; null for any other text."""
    return F.when(text.rlike(NUMBER_TEXT), F.when(F.contains(text, F.lit("_")), F.replace(
        text, F.lit("_"), F.lit(""))).otherwise(text).try_cast("double"))


def number_fault(text: Column) -> Column:
    """Why a trimmed text without a finite number has none."""
    words = [re.escape(w) for w in contract.EMPTY_NUMBER_TEXT]
    return (F.when(text.isNull(), "null").when(text.rlike(rf"(?i)\A(?:{'|'.join(words)})\z"), "empty")
            .when(text.rlike(r"(?i)^[+-]nan$"), "nan")
            .when(text.rlike(INFINITE_TEXT) | text.rlike(NUMBER_TEXT), "inf")
            .otherwise("non_numeric"))


def parse_number(raw: Column) -> Column:
    """``struct(value, reason)`` of a raw text; exactly one of the two is null."""
    text = F.trim(raw.cast("string"))
    plain = number_in(text)
    nothing = F.lit(None)
    return F.when(F.abs(plain) != float("inf"), F.struct(plain.alias("value"), nothing.cast("string").alias("reason"))) \
        .otherwise(F.struct(nothing.cast("double").alias("value"), number_fault(text).alias("reason")))


def wilson(successes: Column, trials: Column, z: float = contract.WILSON_Z) -> Column:
    """95 % score interval as ``struct(point, low, high)``, null without trials."""
    n = trials.cast("double")
    p = ratio(successes, trials)
    spread = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / spread
    half = F.lit(z) / spread * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.when(trials > 0, F.struct(
        p.alias("point"),
        F.least(p, F.greatest(zero, centre - half)).alias("low"),
        F.greatest(p, F.least(one, centre + half)).alias("high")))


def interpolate(x: Column, knots: Column, levels: Column) -> Column:
    """Piecewise-linear value at ``x`` through (knots, levels), clamped at both ends.

    At a repeated knot the rightmost one decides. Knots are sorted, at most 127 of them;
    how many lie at or below ``x`` is found by halving.
    """
    steps = F.array(*[F.lit(1 << i) for i in range(6, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(knots, at + step - 1) <= x, at + step).otherwise(at))
    at, after = below, below + 1
    x0, x1 = F.try_element_at(knots, at), F.try_element_at(knots, after)
    y0, y1 = F.try_element_at(levels, at), F.try_element_at(levels, after)
    return (F.when(below == 0, F.try_element_at(levels, F.lit(1)))
            .when(below >= F.size(knots), F.try_element_at(levels, F.lit(-1)))
            .otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0))))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and projections read but never recompute.

    Spark may push a filter below a projection by repeating its expressions; it does not
    push one below a generator, here one that gives a single row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
