"""Rules that read meaning from column and table names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from . import fixed
from .types import contains_any, ends_with_any, is_numeric, is_temporal


def role(name: str, dt: T.DataType) -> str:
    """time_dimension, measure or dimension, from a schema field."""
    lowered = name.lower()
    if is_temporal(dt) or any(w in lowered for w in fixed.ROLE_TIME_WORDS):
        return "time_dimension"
    if is_numeric(dt) and not any(w in lowered for w in fixed.ROLE_ID_WORDS):
        return "measure"
    return "dimension"


def role_of(name: Column, type_text: Column, numeric: Column | None = None) -> Column:
    """The same rule for catalog rows, where the type is text."""
    from .types import type_family

    lowered = F.lower(name)
    timed = contains_any(F.lower(type_text), fixed.TEMPORAL_TYPE_WORDS) | contains_any(
        lowered, fixed.ROLE_TIME_WORDS
    )
    if numeric is None:
        numeric = type_family(type_text) == "numeric"
    return (
        F.when(timed, F.lit("time_dimension"))
        .when(numeric & ~contains_any(lowered, fixed.ROLE_ID_WORDS), F.lit("measure"))
        .otherwise(F.lit("dimension"))
    )


def temporal_score(name: str, dt: T.DataType) -> tuple[int, list[str]]:
    """How likely a column carries the recency of its table, and why."""
    lowered = name.lower()
    tests = (
        (is_temporal(dt), fixed.TEMPORAL_TYPE_POINTS, "temporal type"),
        (lowered.endswith(fixed.TEMPORAL_SUFFIXES), fixed.TEMPORAL_SUFFIX_POINTS,
         "temporal suffix"),
        (any(w in lowered for w in fixed.EVENT_WORDS), fixed.EVENT_WORD_POINTS,
         "temporal name"),
        (any(w in lowered for w in fixed.RECENCY_WORDS), fixed.RECENCY_WORD_POINTS,
         "recency-oriented name"),
    )
    hits = [(points, reason) for hit, points, reason in tests if hit]
    return sum(points for points, _ in hits), [reason for _, reason in hits]


def temporal_by_name_and_type(name: Column, type_text: Column) -> Column:
    return ends_with_any(F.lower(name), fixed.TEMPORAL_SUFFIXES) & contains_any(
        F.lower(type_text), fixed.TEMPORAL_TYPE_WORDS
    )


def singular_stems(table: Column) -> Column:
    """Every plausible singular of a table name, as an array."""
    t = F.lower(table)
    return F.array_distinct(
        F.array_compact(
            F.array(
                t,
                F.when(F.endswith(t, F.lit("ies")),
                       F.concat(_drop_tail(t, 3), F.lit("y"))),
                F.when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")),
                       _drop_tail(t, 1)),
            )
        )
    )


def _drop_tail(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)
