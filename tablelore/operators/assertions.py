"""Compare the result of a query with an expected number."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.types import ref

_COMPARISONS = {
    "eq": lambda actual, expected: actual == expected,
    "gt": lambda actual, expected: actual > expected,
    "lt": lambda actual, expected: actual < expected,
    "gte": lambda actual, expected: actual >= expected,
    "lte": lambda actual, expected: actual <= expected,
}


def check(df: DataFrame, operator: str = "eq", expected: float = 0.0,
          name: str | None = None) -> DataFrame:
    """Judge the first column of the first row; null or text never passes.

    A query without rows fails the job: there is nothing to judge.
    """
    if operator not in _COMPARISONS:
        raise ValueError(
            f"invalid operator {operator!r}; use one of {', '.join(sorted(_COMPARISONS))}")
    value = ref(df.columns[0])
    first = df.limit(1).agg(
        F.count(F.lit(1)).alias("n"),
        F.first(value.cast("string").try_cast("double")).alias("actual"))
    guarded = F.when(F.col("n") == 0, F.raise_error(
        F.lit("assertion query returned no rows")).cast("double")).otherwise(F.col("actual"))
    return first.select(F.lit(name).cast("string").alias("name"), guarded.alias("actual")
                        ).select(
        "name", "actual",
        F.lit(operator).alias("operator"),
        F.lit(float(expected)).alias("expected"),
        F.coalesce(_COMPARISONS[operator](F.col("actual"), F.lit(float(expected))),
                   F.lit(False)).alias("passed"),
    )


def assert_sql(spark: SparkSession, sql: str, operator: str = "eq", expected: float = 0.0,
               name: str | None = None) -> DataFrame:
    return check(spark.sql(sql), operator, expected, name)


def assertion_suite(spark: SparkSession, assertions: Iterable[Mapping]) -> DataFrame:
    """Many named assertions as one result; each has sql, operator, expected, name."""
    return reduce(DataFrame.unionByName, [assert_sql(spark, **a) for a in assertions])
