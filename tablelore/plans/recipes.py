"""Whole investigations.  Each returns named lazy DataFrames; run the ones you need."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import knowledge
from ..operators.columns import column_categories, columns_by_category
from ..operators.diff import count_drift, diff_since, null_regression, schema_diff
from ..operators.joins import join_candidates
from ..operators.profile import profile
from ..operators.quality import quality
from ..operators.values import distinct_values, distribution, values_summary
from ..sources.sampling import Scan
from ..sources.tables import column_catalog, inspect, row_counts


def _scan(source: DataFrame | Scan) -> Scan:
    return source if isinstance(source, Scan) else Scan(source)


def table_report(tables: Mapping[str, DataFrame], table: str,
                 facts: DataFrame | None = None, exact: bool = False
                 ) -> dict[str, DataFrame]:
    """Everything a report on one table shows."""
    df = tables[table]
    out = {
        "context": knowledge.context(df, table, facts, exact=exact),
        "quality": (knowledge.quality_with_facts(df, facts, table, exact)
                    if facts is not None else quality(df, exact=exact)),
        "joins": join_candidates(column_catalog(tables), table),
    }
    if facts is not None:
        out["facts"] = facts.where(F.col("table_name") == table)
    return out


def feature_target(source: DataFrame | Scan, table: str, target: str,
                   exact: bool = False) -> dict[str, DataFrame]:
    """First look at a table with a column to predict."""
    scan = _scan(source)
    return {
        "schema": inspect(scan.data, table),
        "profile": profile(scan, exact=exact),
        "quality": quality(scan, exact=exact),
        "target": distribution(scan, target),
    }


def wide_table_triage(source: DataFrame | Scan, exact: bool = False) -> dict[str, DataFrame]:
    """Quick statistics and the category of every column."""
    quick = profile(source, quick=True, exact=exact)
    categorized = column_categories(quick)
    return {"quick": quick, "column_category": categorized,
            "categories": columns_by_category(categorized)}


def column_deep_dive(source: DataFrame | Scan, table: str, column: str, top: int = 20
                     ) -> dict[str, DataFrame]:
    """Schema, distinct values and distribution around one column."""
    scan = _scan(source)
    return {
        "schema": inspect(scan.data, table),
        "summary": values_summary(scan.data, column, top),
        "values": distinct_values(scan.data, column, top),
        "distribution": distribution(scan, column),
    }


def table_summary(source: DataFrame | Scan, table: str, exact: bool = False
                  ) -> dict[str, DataFrame]:
    """Schema, quick profile and quality of one table."""
    scan = _scan(source)
    return {
        "schema": inspect(scan.data, table),
        "profile": profile(scan, quick=True, exact=exact),
        "quality": quality(scan, exact=exact),
    }


def table_handoff(source: DataFrame | Scan, table: str, exact: bool = False
                  ) -> dict[str, DataFrame]:
    """The table summary; statistics of an empty table are left out as empty frames."""
    parts = table_summary(source, table, exact)
    parts["profile"] = parts["profile"].where(F.col("total_rows") > 0)
    parts["quality"] = parts["quality"].where(F.col("row_count") > 0)
    return parts


def table_investigate(
    source: DataFrame | Scan, table: str, facts: DataFrame | None = None,
    snapshots: DataFrame | None = None, before: Column | None = None,
    focus: str | None = None, top: int = 20, exact: bool = False,
) -> dict[str, DataFrame]:
    """Context and quality, and on request what changed and a look at one column."""
    scan = _scan(source)
    out = {
        "context": knowledge.context(scan, table, facts, exact=exact),
        "quality": quality(scan, exact=exact),
    }
    if snapshots is not None:
        catalog = column_catalog({table: scan.data})
        out["since"] = diff_since(snapshots, catalog, row_counts({table: scan.data}), before)
    if focus is not None:
        out["values"] = distinct_values(scan.data, focus, top)
        out["distribution"] = distribution(scan, focus)
    return out


def schema_compare(tables: Mapping[str, DataFrame], left: str, right: str
                   ) -> dict[str, DataFrame]:
    """Schema difference of two tables, and join candidates when there is one."""
    catalog = column_catalog(tables)
    name = F.col("table_name")
    difference = schema_diff(catalog.where(name == left), catalog.where(name == right),
                             by_table=False)
    differs = difference.where(F.col("change") != "unchanged").limit(1).agg(
        F.count(F.lit(1)) > 0).scalar()
    joins = join_candidates(catalog, left, right).where(differs)
    return {"diff": difference, "joins": joins}


def migration_check(before: DataFrame, after: DataFrame, max_drift_pct: float = 1.0
                    ) -> dict[str, DataFrame]:
    """Row count drift against a limit, schema difference and new nulls."""
    drift = count_drift(before, after)
    left, right = (column_catalog({"t": df}) for df in (before, after))
    return {
        "drift": drift.withColumn("passed", F.coalesce(
            F.col("drift_pct") <= max_drift_pct, F.lit(False))),
        "schema": schema_diff(left, right, by_table=False),
        "nulls": null_regression(before, after),
    }
