"""How recent a table is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed
from ..functions.names import temporal_score
from ..functions.numbers import exact_round, fixed_text, share
from ..functions.types import as_text, is_orderable, is_text, ref

# Text that starts like an ISO date, with or without separators.
_ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"
_BASIC_DATE = r"^\s*\d{8}\s*$"


def _moment(c: Column, dt: T.DataType) -> Column:
    """Point in time of a value; null when it has none."""
    if is_text(dt):
        text = F.trim(c)
        return (
            F.when(text.rlike(_ISO_DATE), text.try_cast("timestamp"))
            .when(text.rlike(_BASIC_DATE), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        )
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    return F.lit(None).cast("timestamp")


def _iso(moment: Column, raw: Column) -> Column:
    """Date alone at midnight, otherwise date, time and offset; unparsed text as it is."""
    midnight = moment == F.date_trunc("day", moment)
    return (
        F.when(moment.isNull(), raw)
        .when(midnight, F.date_format(moment, "yyyy-MM-dd"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx"))
    )


def _candidates(df: DataFrame, column: str | None) -> list[tuple[str, T.DataType, int, list]]:
    found = []
    for f in df.schema.fields:
        score, reasons = temporal_score(f.name, f.dataType)
        if score > 0 and (column is None or f.name.lower() == column.lower()):
            found.append((f.name, f.dataType, score, reasons))
    return sorted(found, key=lambda c: (-c[2], c[0]))


def freshness_candidates(df: DataFrame, column: str | None = None,
                         as_of: Column | None = None) -> DataFrame:
    """Every column that may carry recency, with its span and age, from one scan.

    ``as_of`` is the clock the age is measured against, the current time by default.
    """
    clock = (F.current_timestamp() if as_of is None else as_of).cast("timestamp")
    found = _candidates(df, column)
    spark = df.sparkSession
    if not found:
        return spark.createDataFrame([], (
            "column_name string, column_type string, score int, reasons array<string>, "
            "row_count bigint, non_null_count bigint, null_count bigint, null_pct double, "
            "earliest_value string, latest_value string, latest_age_days double"))
    items = []
    for name, dt, score, reasons in found:
        c = ref(name)
        if not is_orderable(dt):
            c = as_text(name, dt)
        lo, hi = F.min(c), F.max(c)
        items.append(F.struct(
            F.lit(name).alias("column_name"),
            F.lit(dt.simpleString()).alias("column_type"),
            F.lit(score).alias("score"),
            F.array(*[F.lit(r) for r in reasons]).alias("reasons"),
            F.count(F.lit(1)).alias("row_count"),
            F.count(c).alias("non_null_count"),
            _iso(_moment(lo, dt), lo.cast("string")).alias("earliest_value"),
            _iso(_moment(hi, dt), hi.cast("string")).alias("latest_value"),
            _moment(hi, dt).alias("latest"),
        ))
    rows = df.agg(F.array(*items).alias("items")).select(F.inline("items"))
    nulls = F.col("row_count") - F.col("non_null_count")
    age = F.timestamp_diff("MICROSECOND", F.col("latest"), clock) / F.lit(86_400_000_000.0)
    return rows.select(
        "column_name", "column_type", "score", "reasons", "row_count", "non_null_count",
        nulls.alias("null_count"),
        F.coalesce(exact_round(share(nulls, F.col("row_count")), 2), F.lit(0.0)).alias(
            "null_pct"),
        "earliest_value", "latest_value", exact_round(age, 2).alias("latest_age_days"),
    )


def freshness(df: DataFrame, column: str | None = None, stale_after_days: float = 7,
              as_of: Column | None = None) -> DataFrame:
    """One row: fresh, stale or unknown, judged by the best temporal column.

    Among columns with values the choice is: parseable, youngest, highest score, most
    values, name.  A time ahead of the clock counts as fresh.
    """
    found = freshness_candidates(df, column, as_of)
    age = F.col("latest_age_days")
    preference = F.struct(
        age.isNull(), F.coalesce(age, F.lit(0.0)), -F.col("score"),
        -F.col("non_null_count"), F.col("column_name"))
    populated = F.col("non_null_count") > 0
    best = F.min_by(
        F.struct("column_name", "earliest_value", "latest_value", "latest_age_days"),
        F.when(populated, preference))
    picked = found.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("candidate_count"),
        best.alias("b"),
    )
    if not _candidates(df, column):
        picked = picked.withColumn("row_count", df.agg(F.count(F.lit(1))).scalar())
    name, days = F.col("b.column_name"), F.col("b.latest_age_days")
    limit = F.lit(float(stale_after_days))
    status = (
        F.when(days.isNull(), "unknown").when(days <= limit, "fresh").otherwise("stale"))
    reason = (
        F.when(F.col("candidate_count") == 0, fixed.NO_TEMPORAL_COLUMN)
        .when(name.isNull(), fixed.NO_TEMPORAL_VALUE)
        .when(days.isNull(), F.format_string(fixed.UNREADABLE_TIME, name))
        .otherwise(F.format_string(fixed.NEWEST_VALUE, name, fixed_text(days, 1),
                                   F.lit(str(stale_after_days))))
    )
    return picked.select(
        "row_count", limit.alias("stale_after_days"), status.alias("status"),
        name.alias("selected_column"), "candidate_count",
        F.col("b.earliest_value").alias("earliest_value"),
        F.col("b.latest_value").alias("latest_value"),
        days.alias("latest_age_days"), reason.alias("reason"),
    )
