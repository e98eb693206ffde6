"""What a column is for: its role and its category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.names import role_of


def column_roles(catalog: DataFrame) -> DataFrame:
    """Catalog rows with ``role``: time_dimension, measure or dimension."""
    return catalog.withColumn("role", role_of(F.col("column_name"), F.col("data_type")))


def category_of(distinct: Column, null_pct: Column, rows: Column, role: Column) -> Column:
    return (
        F.when(distinct == 1, "constant")
        .when(null_pct > fixed.SPARSE_CATEGORY_PCT, "sparse")
        .when((rows > 0) & (distinct / rows > fixed.HIGH_CARDINALITY_SHARE),
              "high_cardinality")
        .when(role == "time_dimension", "time")
        .when(role == "measure", "measure")
        .when(distinct < fixed.LOW_CARDINALITY_LIMIT, "low_cardinality")
        .otherwise("other")
    )


def column_categories(stats: DataFrame) -> DataFrame:
    """Profile rows with ``role`` and ``category``; a quick profile is enough."""
    with_role = stats.withColumn(
        "role", role_of(F.col("column_name"), F.col("column_type")))
    return with_role.withColumn("category", category_of(
        F.col("distinct_count"), F.coalesce("null_pct", F.lit(0.0)), F.col("total_rows"),
        F.col("role")))


def columns_by_category(categorized: DataFrame) -> DataFrame:
    """One row per category with its columns in table order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))),
                         lambda s: s["column_name"])
    return categorized.groupBy("category").agg(
        listed.alias("columns"), F.count(F.lit(1)).alias("column_count"))
