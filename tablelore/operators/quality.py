"""Null and uniqueness signals, allowed values, duplicate rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed
from ..functions.numbers import exact_round, fixed_text, share
from ..functions.types import as_text, is_nested, is_text, ref, sql_name, sql_struct
from ..sources.rows import pick_columns
from ..sources.sampling import Scan
from . import counts
from .profile import (
    NO_EXTREMES, approx_distinct, clamp_distinct, described, exact_distincts, extremes,
    per_column,
)

# Allowed values up to this many travel inside the scan as literals; larger sets are
# joined to the counted values.
LITERAL_VALUES = 1000


def signals(null_pct: Column, distinct: Column, rows: Column) -> Column:
    """What the numbers show, as text; a signal is a description, never a failure."""
    unique = F.lit(100.0) * distinct / rows
    return F.array_compact(F.array(
        F.when(null_pct > fixed.NULL_SIGNAL_PCT,
               F.concat(null_pct.cast("string"), F.lit(fixed.NULL_SIGNAL))),
        F.when((rows > 0) & (distinct == 0), F.lit(fixed.ALL_NULL_SIGNAL)),
        F.when((rows > 0) & (distinct > 0) & (unique < fixed.UNIQUE_SIGNAL_PCT),
               F.concat(fixed_text(unique, 1), F.lit(fixed.UNIQUE_SIGNAL))),
    ))


def _checks(df: DataFrame, pos: int, name: str, permitted: Sequence | None
            ) -> str | Column:
    """What compiles to one loop: counts, and extremes of fixed-width values."""
    dt = df.schema[name].dataType
    found = sql_struct({
        "pos": str(pos), "row_count": "count(1)",
        "null_count": f"count(1) - count({sql_name(name)})",
        "invalid_count": "cast(null as bigint)",
        "allowed_count": f"cast({len(permitted) if permitted else 'null'} as int)",
        **(NO_EXTREMES if is_text(dt) else extremes(name, dt)),
    })
    if not permitted:
        return found
    return F.expr(found).withField("invalid_count", F.count_if(outside(df, name, permitted)))


def _sketched(df: DataFrame, pos: int, name: str, distinct: bool) -> str:
    """What does not: the distinct sketch and extremes of text."""
    dt = df.schema[name].dataType
    c, none = sql_name(name), "cast(null as string)"
    return sql_struct({
        "pos": str(pos),
        "text_min": f"min({c})" if is_text(dt) else none,
        "text_max": f"max({c})" if is_text(dt) else none,
        "distinct_count": approx_distinct(name, dt) if distinct else "cast(null as bigint)",
    })


def outside(df: DataFrame, column: str, permitted: Sequence) -> Column:
    """Non-null and not among the permitted values."""
    c = ref(column)
    if all(isinstance(v, str) for v in permitted):
        c = as_text(column, df.schema[column].dataType)
    return F.coalesce(c.isNotNull() & ~c.isin(*permitted), F.lit(False))


def quality(
    source: DataFrame | Scan,
    columns: Sequence[str] | str | None = None,
    exact: bool = False,
    allowed: Mapping[str, Sequence] | None = None,
    batch_columns: int | None = None,
) -> DataFrame:
    """One row per column with null rate, uniqueness, extremes, signals and issues.

    ``allowed`` maps a column to its permitted values; a few of them are counted in the
    same pass, many are joined to the counted values. They are the only thing that sets
    ``status`` to ``fail``.  ``row_count`` is the
    number of rows scanned, so a sample reports its own size.
    """
    df = source.data if isinstance(source, Scan) else source
    names = pick_columns(df, columns)
    allowed = {c.lower(): v for c, v in (allowed or {}).items() if v}
    large = {c: allowed.pop(c) for c in list(allowed) if len(allowed[c]) > LITERAL_VALUES}
    stats = per_column(df, names, lambda i, c: _checks(df, i, c, allowed.get(c.lower())),
                       batch_columns)
    second = per_column(df, names, lambda i, c: _sketched(df, i, c, not exact), batch_columns)
    if exact:
        second = second.drop("distinct_count").join(exact_distincts(df, names), "pos", "left")
    stats = (
        described(stats, df, names).join(second, "pos", "left")
        .withColumn("min_text", F.coalesce("min_text", "text_min"))
        .withColumn("max_text", F.coalesce("max_text", "text_max"))
    )
    if large:
        spark = df.sparkSession
        listed = spark.createDataFrame([(c, str(v)) for c, vs in large.items() for v in vs],
                                       "column_name string, value string")
        counted = invalid_values(df, listed, [c for c in names if c.lower() in large]).select(
            "pos", F.col("invalid_count").alias("outside"),
            F.col("allowed_count").alias("listed"))
        stats = stats.join(counted, "pos", "left").withColumns({
            "invalid_count": F.coalesce("outside", "invalid_count"),
            "allowed_count": F.coalesce(F.col("listed").cast("int"), "allowed_count")})
    rows = F.col("row_count")
    return (
        stats.withColumn("distinct_count", clamp_distinct(
            F.coalesce("distinct_count", F.lit(0)), rows))
        .withColumn("null_pct", F.coalesce(
            exact_round(share(F.col("null_count"), rows), 2), F.lit(0.0)))
        .withColumn("uniqueness_pct", F.coalesce(
            exact_round(share(F.col("distinct_count"), rows), 2), F.lit(0.0)))
        .withColumn("signals", F.when(rows > 0, signals(
            F.col("null_pct"), F.col("distinct_count"), rows)).otherwise(F.array()))
        .withColumn("issues", F.when(F.col("invalid_count") > 0, F.array(issue_text(
            F.col("invalid_count"), F.col("allowed_count")))).otherwise(F.array()))
        .withColumn("status", F.when(F.col("invalid_count") > 0, "fail").otherwise("ok"))
        .select("pos", "column_name", "column_type", "row_count", "null_count", "null_pct",
                "distinct_count", "uniqueness_pct", "min_val", "max_val", "min_text",
                "max_text", "status", "signals", "issues", "invalid_count")
    )


def issue_text(invalid: Column, allowed: Column) -> Column:
    return F.format_string(fixed.INVALID_ISSUE, invalid.cast("string"), allowed.cast("string"))


def _canonical(names: Sequence[str]) -> Column:
    """The spelling of a column name in the table; null for other names."""
    pairs = [F.lit(x) for c in names for x in (c.lower(), c)]
    return F.element_at(F.create_map(*pairs), F.lower("column_name"))


def _as_stored(df: DataFrame, names: Sequence[str]) -> Column:
    """An allowed value in the text form that its column gives it; other texts stay."""
    value = F.col("value")
    by_type: dict[str, list[str]] = {}
    for name in names:
        dt = df.schema[name].dataType
        if not is_text(dt) and not is_nested(dt):
            by_type.setdefault(dt.simpleString(), []).append(name)
    for kind, columns in by_type.items():
        stored = F.col("value").try_cast(kind)
        if isinstance(df.schema[columns[0]].dataType, T.IntegralType):
            number = F.col("value").try_cast("decimal(38,10)")  # 2.0 is a whole number
            stored = F.coalesce(stored, F.when(number == F.floor(number), number).try_cast(kind))
        stored = stored.cast("string")
        value = F.when(F.lower("column_name").isin(*[c.lower() for c in columns]),
                       F.coalesce(stored, F.col("value"))).otherwise(value)
    return value


def invalid_values(df: DataFrame, allowed: DataFrame,
                   columns: Sequence[str] | str | None = None) -> DataFrame:
    """Check columns against a table of allowed values ``(column_name, value)``.

    The table's values are counted first, so the join sees one row per distinct value
    and no key is heavier than another.  Columns without allowed values do not appear.
    Names match in any case, and values as the column has them: ``1.50`` allows ``1.5``
    in a column of doubles.
    """
    names = pick_columns(df, columns)
    permitted = allowed.select(_canonical(names).alias("column_name"),
                               _as_stored(df, names).alias("value")).where(
        F.col("column_name").isNotNull()).distinct()
    sizes = permitted.groupBy("column_name").agg(F.count("value").alias("allowed_count"))
    checked = (
        counts.text_counts(df, names)
        .join(permitted.withColumn("known", F.lit(True)), ["column_name", "value"], "left")
        .groupBy("pos", "column_name")
        .agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull() & F.col("known").isNull(),
                                    F.col("n"))), F.lit(0)).alias("invalid_count"),
        )
        .join(sizes, "column_name")
    )
    bad = F.col("invalid_count") > 0
    return checked.withColumn("status", F.when(bad, "fail").otherwise("ok")).withColumn(
        "issue", F.when(bad, issue_text(F.col("invalid_count"), F.col("allowed_count"))))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | str | None = None,
                   hash_first: bool = False) -> DataFrame:
    """Copies beyond the first over all groups of equal rows, as one row.

    Copies are counted before the shuffle, so a row repeated many times is light.
    ``hash_first`` reads the table twice: a first round groups 8-byte hashes, and only
    rows whose hash repeats are compared in full.  It pays for wide rows with few
    copies, where a single round would shuffle the whole table.
    """
    names = pick_columns(df, columns)
    values = df.select(*[
        (F.to_json(ref(c)) if is_nested(df.schema[c].dataType) else ref(c)).alias(f"c{i}")
        for i, c in enumerate(names)
    ])
    keys = values.columns
    if hash_first:
        hashed = values.withColumn("h", F.xxhash64(*keys))
        repeated = (hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") > 1).select("h"))
        grouped = (hashed.join(repeated, "h", "left_semi")
                   .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    else:
        grouped = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") > 1).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicated_groups"),
    )
