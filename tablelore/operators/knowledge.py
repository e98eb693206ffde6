"""Facts a scan can prove, and scans that show the facts already known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.names import temporal_by_name_and_type
from ..functions.types import as_text, is_nested, is_numeric, is_text, sql_struct
from ..sources.rows import pick_columns, preview
from ..sources.sampling import Scan
from ..sources.tables import column_catalog
from . import facts as f
from .profile import approx_distinct, described, per_column, profile, top_sketch
from .quality import quality
from .values import distinct_values, top_values

# A sketch with this many slots lists every value of a column that the distinct
# estimate puts below the bound; the bound leaves room for the estimate's error.
_SLOTS = 1024
_SURELY_SMALL = 100


def _fact(table: str, column: Column, field: str, value: Column | None,
          values: Column | None, confidence: float, source: str) -> list[Column]:
    return [
        F.lit(table).alias("table_name"), column.alias("column_name"),
        F.lit(field).alias("field"),
        (F.lit(None).cast("string") if value is None else value).alias("value"),
        (F.lit(None).cast("array<string>") if values is None else values).alias("values"),
        F.lit(confidence).alias("confidence"), F.lit(source).alias("source"),
    ]


def temporal_facts(stats: DataFrame, table: str) -> DataFrame:
    """Columns named and typed like a time, from profile or catalog rows."""
    type_column = "column_type" if "column_type" in stats.columns else "data_type"
    return stats.where(
        temporal_by_name_and_type(F.col("column_name"), F.col(type_column))
    ).select(*_fact(table, F.col("column_name"), "temporal", F.lit("true"), None,
                    fixed.TEMPORAL_CONFIDENCE, "profile"))


def sparse_facts(stats: DataFrame, table: str) -> DataFrame:
    """Columns that are almost always null, from profile or quality rows."""
    return stats.where(F.col("null_pct") > fixed.SPARSE_FACT_PCT).select(
        *_fact(table, F.col("column_name"), "likely_sparse", F.lit("true"), None,
               fixed.SPARSE_CONFIDENCE, "quality"))


def small_value_sets(df: DataFrame, columns: Sequence[str] | str | None = None
                     ) -> DataFrame:
    """All distinct values of every text column that has fewer than twenty.

    One scan, nothing but sketches is shuffled: a frequency sketch is exact while the
    distinct values fit its slots, and the distinct estimate tells when they do.
    """
    names = [c for c in pick_columns(df, columns) if is_text(df.schema[c].dataType)]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, distinct_count bigint, values array<string>")
    top = fixed.VALID_VALUES_CEILING
    rows = described(per_column(df, names, lambda i, c: sql_struct({
        "pos": str(i),
        "estimate": approx_distinct(c, df.schema[c].dataType),
        "found": f"transform({top_sketch(c, df.schema[c].dataType, top, _SLOTS)}, "
                 "s -> s.value)",
    })), df, names)
    size = F.size("found")
    return rows.where(
        (F.col("estimate") < _SURELY_SMALL) & (size > 0) & (size < top)
    ).select("column_name", size.cast("bigint").alias("distinct_count"),
             F.array_sort("found").alias("values"))


def valid_values_facts(df: DataFrame, table: str,
                       columns: Sequence[str] | str | None = None,
                       at_least: int = 1) -> DataFrame:
    """The allowed values of low-cardinality text columns."""
    return small_value_sets(df, columns).where(F.col("distinct_count") >= at_least).select(
        *_fact(table, F.col("column_name"), "valid_values", None, F.col("values"),
               fixed.VALID_VALUES_CONFIDENCE, "values"))


def derived_facts(source: DataFrame | Scan, table: str) -> DataFrame:
    """Every fact one look at the table proves: temporal, sparse, valid values."""
    df = source.data if isinstance(source, Scan) else source
    stats = profile(source, quick=True)
    return (
        temporal_facts(column_catalog({table: df}), table)
        .unionByName(sparse_facts(stats, table))
        .unionByName(valid_values_facts(df, table))
    )


def suggestions(source: DataFrame | Scan, table: str, current: DataFrame,
                force: bool = False) -> DataFrame:
    """Derived facts that are new: not stored already, not a person's field.

    Only columns that the store knows get any. Constant columns and times get no list of
    values.
    """
    df = source.data if isinstance(source, Scan) else source
    temporal = temporal_facts(column_catalog({table: df}), table)
    listed = valid_values_facts(df, table, at_least=2).join(
        temporal.select("column_name"), "column_name", "left_anti")
    candidates = temporal.unionByName(
        sparse_facts(profile(source, quick=True), table)).unionByName(listed)
    known = f._folded(current, "old")
    stored = current.where(F.col("column_name").isNotNull()).select(
        "table_name", F.lower("column_name").alias("column_key")).distinct()
    joined = f._keyed(candidates).join(stored, ["table_name", "column_key"], "left_semi").join(
        known, list(f._KEY), "left")
    protected = f.is_human("old.") if not force else F.lit(False)
    # A list stored by hand and the same list stored by a scan compare alike.
    same = F.col("values").eqNullSafe(F.col("old.values")) & F.lower("value").eqNullSafe(
        F.lower("old.value")) & f.by_scan("old.")
    return joined.where(
        ~F.coalesce(protected, F.lit(False)) & ~F.coalesce(same, F.lit(False))
    ).select("table_name", "column_name", "field", "value", "values", "confidence", "source")


def facts_by_column(current: DataFrame, table: str) -> DataFrame:
    """One row per column (``column_key``, lower-cased) with the stored fields scans show."""
    shown = f.shown_value()

    def field(name: str) -> Column:
        return F.max(F.when(F.col("field") == name, shown)).alias(name)

    return (
        current.where((F.lower("table_name") == table.lower()) & F.col("column_name").isNotNull()
                      & F.col("field").isin(*fixed.SCAN_COLUMN_FIELDS))
        .groupBy(F.lower("column_name").alias("column_key"))
        .agg(
            field("description"),
            F.max(F.when((F.col("field") == "valid_values") & (F.size("values") > 0),
                         F.col("values"))).alias("valid_values"),
            field("pii"), field("temporal"), field("likely_sparse"),
        )
    )


def with_facts(stats: DataFrame, current: DataFrame, table: str) -> DataFrame:
    """Profile, quality or context rows with the stored facts of their columns."""
    return _keyed_by_column(stats).join(
        facts_by_column(current, table), "column_key", "left").drop("column_key")


def _keyed_by_column(rows: DataFrame) -> DataFrame:
    return rows.withColumn("column_key", F.lower("column_name"))


def values_with_facts(df: DataFrame, column: str, current: DataFrame, table: str,
                      max_values: int | None = None, sort: str = "value") -> DataFrame:
    """The distinct values of a column beside what is stored about it."""
    listed = distinct_values(df, column, max_values, sort)
    known = facts_by_column(current, table).where(
        F.col("column_key") == column.lower()).select("description", "valid_values", "pii")
    stored = known.agg(*(F.first(c).alias(c) for c in known.columns))  # one row, or nulls
    return listed.withColumn("_f", stored.select(F.struct("*")).scalar()).select(
        *listed.columns, "_f.*")


def quality_with_facts(source: DataFrame | Scan, current: DataFrame, table: str,
                       exact: bool = False) -> DataFrame:
    """Quality rows checked against the stored allowed values.

    The allowed values come from the fact table at run time, so they are joined to the
    counted values instead of entering the scan as literals.
    """
    from .quality import invalid_values, issue_text

    df = source.data if isinstance(source, Scan) else source
    known = facts_by_column(current, table)
    allowed = known.where(F.col("valid_values").isNotNull()).select(
        F.col("column_key").alias("column_name"), F.explode("valid_values").alias("value"))
    checked = invalid_values(df, allowed, _comparable(df)).select(
        "column_name", "invalid_count", "allowed_count")
    rows = quality(source, exact=exact).drop("invalid_count", "status", "issues")
    bad = F.col("invalid_count") > 0
    return (
        _keyed_by_column(rows.join(checked, "column_name", "left"))
        .join(known, "column_key", "left").drop("column_key")
        .withColumn("status", F.when(bad, "fail").otherwise("ok"))
        .withColumn("issues", F.when(bad, F.array(issue_text(
            F.col("invalid_count"), F.col("allowed_count")))).otherwise(F.array()))
        .drop("allowed_count")
    )


def _comparable(df: DataFrame) -> list[str]:
    """Columns that listed values can be compared with: all but nested ones."""
    return [s.name for s in df.schema.fields if not is_nested(s.dataType)]


def context(source: DataFrame | Scan, table: str, current: DataFrame | None = None,
            sample_values: int = 5, exact: bool = False) -> DataFrame:
    """Schema, statistics, frequent values and stored facts of every column.

    The default aggregates sketches in a few scans; ``exact`` groups the values instead.
    ``all_values`` tells whether ``sample_values`` are proved to be all the column has:
    their counts add up to all its rows, or one more was asked for and none came.
    """
    scan = source if isinstance(source, Scan) else Scan(source)
    df = scan.data
    if exact or not sample_values:
        stats = profile(scan, exact=exact)
        named = [s.name for s in df.schema.fields if not is_numeric(s.dataType)]
        if named and sample_values:
            listed = top_values(df, named, sample_values + 1).groupBy("column_name").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                            lambda s: s["value"]).alias("top_values"))
            stats = stats.join(listed, "column_name", "left")
        else:
            stats = stats.withColumn("top_values", F.lit(None).cast("array<string>"))
        stats = stats.withColumn("all_values", F.size("top_values") <= sample_values)
    else:
        stats = profile(scan, top=sample_values)
    schema = column_catalog({table: df}).select("column_name", "nullable", "comment")
    rows = stats.join(schema, "column_name").withColumn(
        "sample_values", F.slice("top_values", 1, max(sample_values, 1))).drop("top_values")
    return with_facts(rows, current, table) if current is not None else rows


def facts_from_context(context_rows: DataFrame, table: str) -> DataFrame:
    """Facts a context scan proves; values only when the sample holds them all."""
    size = F.size("sample_values")
    complete = (
        (F.col("column_type") == "string") & F.col("all_values") & (size > 0)
        & (size < fixed.VALID_VALUES_CEILING)
    )
    listed = context_rows.where(complete).select(
        *_fact(table, F.col("column_name"), "valid_values", None,
               F.array_sort(F.array_distinct("sample_values")),
               fixed.VALID_VALUES_CONFIDENCE, "context"))
    return (
        listed
        .unionByName(sparse_facts(context_rows, table).withColumn("source", F.lit("context")))
        .unionByName(temporal_facts(context_rows, table).withColumn(
            "source", F.lit("context")))
    )


def documentation(source: DataFrame | Scan, table: str, samples: int = 3,
                  order_by: Sequence[Column | str] | None = None,
                  exact: bool = False) -> DataFrame:
    """One row per column to document: schema, statistics, a few sample values."""
    scan = source if isinstance(source, Scan) else Scan(source)
    df = scan.data
    shown = preview(df, samples, order_by)
    entries = F.array(*[
        F.struct(F.lit(s.name).alias("column_name"),
                 F.array_join(F.collect_list(as_text(s.name, s.dataType)), ", ").alias(
                     "sample_values"))
        for s in df.schema.fields
    ])
    sampled = shown.agg(entries.alias("items")).select(F.inline("items"))
    schema = column_catalog({table: df}).select(
        "table_name", "ordinal", "column_name", "nullable", "comment")
    return schema.join(profile(scan, exact=exact), "column_name").join(
        sampled, "column_name"
    ).select(
        "table_name", "ordinal", "column_name", "column_type", "nullable", "comment",
        "row_count", "distinct_count", "null_count", "null_pct", "min_val", "max_val",
        "min_length", "max_length", "sample_values",
    )


def machine_facts(documented: DataFrame, table_comment: str = "",
                  primary_key: Sequence[str] = ()) -> DataFrame:
    """Documentation rows as facts: what a refresh writes, with places to describe.

    The first column's row also yields the facts about the table, which have no column.
    """
    keys = [c.lower() for c in primary_key]

    def entry(column: Column, field: str, value: Column) -> Column:
        return F.struct(column.cast("string").alias("column_name"),
                        F.lit(field).alias("field"), value.cast("string").alias("value"))

    name, none = F.col("column_name"), F.lit(None)
    columns = F.array(
        entry(name, "type", F.col("column_type")), entry(name, "nullable", F.col("nullable")),
        entry(name, "primary_key", F.lower(name).isin(*keys) if keys else F.lit(False)),
        entry(name, "description", F.coalesce("comment", F.lit(fixed.DESCRIPTION_PLACE))),
        *[entry(name, c, F.col(c)) for c in (
            "distinct_count", "null_count", "null_pct", "min_val", "max_val",
            "min_length", "max_length", "sample_values")],
    )
    table = F.array(
        entry(none, "row_count", F.col("row_count")),
        entry(none, "table_comment", F.lit(table_comment)),
        *[entry(none, field, F.lit(place)) for field, place in fixed.TABLE_PLACES.items()])
    entries = F.when(F.col("ordinal") == 1, F.concat(columns, table)).otherwise(columns)
    return documented.select("table_name", F.inline(entries)).select(
        "table_name", "column_name", "field", "value",
        F.lit(None).cast("array<string>").alias("values"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
    )
