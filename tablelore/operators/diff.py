"""What changed between two tables, two catalogs or two points in time.

A catalog is ``(table_name, column_name, data_type, nullable)``; a snapshot adds
``taken_at`` and ``row_count``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.types import bare_type
from .profile import profile


def _difference(pairs: DataFrame) -> DataFrame:
    """Classify rows holding the structs ``l`` and ``r`` of one column."""
    l, r = F.col("l"), F.col("r")
    differs = (F.lower("l.data_type") != F.lower("r.data_type")) | (
        F.col("l.nullable") != F.col("r.nullable"))
    change = (
        F.when(l.isNull(), "added").when(r.isNull(), "removed")
        .when(differs, "changed").otherwise("unchanged"))
    return (pairs.withColumn("change", change)
            .withColumn("column_name", F.coalesce("l.column_name", "r.column_name"))
            .withColumn("left_type", F.col("l.data_type"))
            .withColumn("right_type", F.col("r.data_type"))
            .withColumn("left_nullable", F.col("l.nullable"))
            .withColumn("right_nullable", F.col("r.nullable"))
            .drop("l", "r"))


_DIFF_COLUMNS = ("table_name", "column_name", "change", "left_type", "right_type",
                 "left_nullable", "right_nullable")


def _pairs(left: DataFrame, right: DataFrame, by_table: bool, kept: tuple = ()) -> DataFrame:
    """Columns of both catalogs side by side, as the structs ``l`` and ``r``."""
    keys = (["table_key"] if by_table else []) + ["column_key"]

    def side(catalog: DataFrame, name: str, more: tuple = ()) -> DataFrame:
        return catalog.select(
            F.lower("table_name").alias("table_key"),
            F.lower("column_name").alias("column_key"),
            F.struct("table_name", "column_name", "data_type", "nullable", *more).alias(name),
        ).select(*keys, name)

    pairs = side(left, "l", kept).join(side(right, "r"), keys, "full")
    return pairs.withColumn("table_name", F.coalesce("l.table_name", "r.table_name"))


def schema_diff(left: DataFrame, right: DataFrame, by_table: bool = True) -> DataFrame:
    """Every column as added (right only), removed (left only), changed or unchanged.

    Names match in any case.  ``by_table=False`` compares two single-table catalogs
    whatever their table names are.
    """
    return _difference(_pairs(left, right, by_table)).select(*_DIFF_COLUMNS)


def diff_counts(difference: DataFrame) -> DataFrame:
    """Added, removed, changed and unchanged columns per table."""
    def n(change: str) -> Column:
        return F.count_if(F.col("change") == change).alias(change)

    return difference.groupBy("table_name").agg(
        *[n(c) for c in ("added", "removed", "changed", "unchanged")])


def latest_snapshot(snapshots: DataFrame, before: Column | None = None) -> DataFrame:
    """The rows of the newest snapshot of every table, optionally before a moment.

    The newest row per column is found by an aggregate that starts on the map side;
    only those rows meet in one window per table.
    """
    if before is not None:
        snapshots = snapshots.where(F.col("taken_at") < before)
    newest = snapshots.groupBy(
        F.lower("table_name").alias("table_key"), F.lower("column_name").alias("column_key")
    ).agg(F.max(F.struct("taken_at", "table_name", "column_name", "data_type", "nullable",
                         "row_count")).alias("s"))
    table = Window.partitionBy("table_key")
    return (
        newest.select("table_key", "s.*")
        .withColumn("newest", F.max("taken_at").over(table))
        .where(F.col("taken_at") == F.col("newest"))
        .drop("newest", "table_key")
    )


def diff_since(snapshots: DataFrame, current: DataFrame, current_counts: DataFrame,
               before: Column | None = None) -> DataFrame:
    """Current columns against the newest earlier snapshot, with the row count change.

    Only tables of ``current`` are compared, so a dropped table is not there; tables
    without a snapshot are left out: there is nothing to compare them with.
    """
    wanted = current.select(F.lower("table_name").alias("table_key")).distinct()
    snapshots = snapshots.withColumn("table_key", F.lower("table_name")).join(
        wanted, "table_key", "left_semi").drop("table_key")
    pairs = _pairs(latest_snapshot(snapshots, before), current, True,
                   ("taken_at", "row_count"))
    table = Window.partitionBy("table_key")  # the columns of one table
    since = pairs.withColumns({
        "since": F.max("l.taken_at").over(table),
        "previous_row_count": F.max("l.row_count").over(table),
    }).where(F.col("since").isNotNull())
    counts = current_counts.select(
        F.lower("table_name").alias("table_key"),
        F.col("row_count").alias("current_row_count"))
    return (
        _difference(since)
        .join(counts, "table_key", "left")
        .withColumn("row_count_delta",
                    F.col("current_row_count") - F.col("previous_row_count"))
        .select(*_DIFF_COLUMNS, "since", "previous_row_count", "current_row_count",
                "row_count_delta")
    )


def fingerprints(catalog: DataFrame) -> DataFrame:
    """Sixteen hex digits per table that change when a column name or type changes.

    Column order and type parameters do not count.
    """
    pair = F.struct(F.lower("column_name").alias("name"),
                    bare_type(F.upper("data_type")).alias("type"))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(pair)),
                    lambda p: F.concat(p["name"], F.lit(":"), p["type"])), "|")
    return catalog.groupBy("table_name").agg(
        F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"),
        F.count(F.lit(1)).alias("column_count"),
    )


def fingerprint_status(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """match, drift, no_local_table or unknown for every incoming table."""
    return incoming.select(
        "table_name", F.col("fingerprint").alias("incoming_fingerprint")
    ).join(
        local.select("table_name", F.col("fingerprint").alias("local_fingerprint")),
        "table_name", "left",
    ).withColumn("status", _status(F.col("incoming_fingerprint"),
                                   F.col("local_fingerprint")))


def _status(incoming: Column, local: Column) -> Column:
    return (
        F.when(local.isNull() & incoming.isNotNull(), "no_local_table")
        .when(local.isNull() | incoming.isNull(), "unknown")
        .when(local == incoming, "match")
        .otherwise("drift")
    )


def bundle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables only in one of two fingerprint tables, shared, and drifted."""
    both = a.select("table_name", F.col("fingerprint").alias("fingerprint_a")).join(
        b.select("table_name", F.col("fingerprint").alias("fingerprint_b")),
        "table_name", "full")
    fa, fb = F.col("fingerprint_a"), F.col("fingerprint_b")
    return both.withColumn(
        "presence", F.when(fb.isNull(), "only_in_a").when(fa.isNull(), "only_in_b")
        .otherwise("shared")
    ).withColumn("drift", F.coalesce(fa != fb, F.lit(False)))


def count_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of two tables and their difference in percent of the first."""
    counted = before.agg(F.count(F.lit(1)).alias("before_rows")).withColumn(
        "after_rows", after.agg(F.count(F.lit(1))).scalar())
    return counted.withColumn(
        "drift_pct",
        F.abs(F.col("after_rows") - F.col("before_rows")) * F.lit(100.0)
        / F.nullif(F.col("before_rows"), F.lit(0)))


def null_regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shared columns that had no nulls before and have some after."""
    def nulls(df: DataFrame, name: str) -> DataFrame:
        return profile(df, quick=True).select(
            F.lower("column_name").alias("column_key"), "column_name",
            F.col("null_count").alias(name))

    return (
        nulls(before, "before_nulls")
        .join(nulls(after, "after_nulls").drop("column_name"), "column_key")
        .where((F.col("before_nulls") == 0) & (F.col("after_nulls") > 0))
        .select("column_name", "before_nulls", "after_nulls")
    )
