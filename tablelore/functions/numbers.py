"""Rounding.  Two rules are in use, and ties show the difference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sql_round(x: Column, digits: int) -> Column:
    """As databases round doubles: scale, round half away from zero, scale back."""
    scale = F.lit(float(10 ** digits))
    return F.round(x.cast("double") * scale) / scale


def fixed_text(x: Column, digits: int) -> Column:
    """Text with fixed decimals, rounded from the exact binary value, ties to even."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def exact_round(x: Column, digits: int) -> Column:
    """A double rounded from its exact binary value, ties to even."""
    return fixed_text(x, digits).cast("double")


def share(part: Column, whole: Column) -> Column:
    """Percentage, null when the whole is zero."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))
