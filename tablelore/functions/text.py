"""Search terms of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def terms(text: Column) -> Column:
    """Lower-case terms of a text, then the parts of its hyphenated and underscored terms.

    Without lambdas, so that the expression compiles.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(lowered, F.lit(fixed.TOKEN_PATTERN), F.lit(0))
    joined = F.regexp_extract_all(lowered, F.lit(fixed.JOINED_PATTERN), F.lit(0))
    parts = F.array_remove(F.split(F.array_join(joined, " "), "[-_ ]"), "")
    may_join = F.contains(lowered, F.lit("-")) | F.contains(lowered, F.lit("_"))
    return F.concat(found, F.when(may_join, parts).otherwise(
        F.array().cast("array<string>")))


def has_content(value: Column) -> Column:
    """False for null, blank and ``<placeholder>`` text."""
    trimmed = F.trim(value)
    return F.coalesce((trimmed != "") & ~F.startswith(trimmed, F.lit("<")), F.lit(False))
