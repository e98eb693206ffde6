"""Distinct values, their frequencies and their distribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import exact_round, share
from ..functions.types import (
    as_number, as_text, is_nested, is_numeric, ref, sql_name, sql_struct,
)
from ..sources.rows import pick_column, pick_columns
from ..sources.sampling import Scan
from ..store import written
from . import counts
from .profile import TRACKED_VALUES, can_be_tracked, per_column


def _data(source: DataFrame | Scan) -> DataFrame:
    return source.data if isinstance(source, Scan) else source


def _grouped(df: DataFrame, column: str) -> DataFrame:
    name = pick_column(df, column)
    dt = df.schema[name].dataType
    value = as_text(name, dt) if is_nested(dt) else ref(name)
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _totals(grouped: DataFrame, max_values: int | None) -> DataFrame:
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias(
            "null_count"),
        F.count("value").alias("distinct_count"),
    ).withColumn("truncated", F.lit(False) if max_values is None
                 else F.col("distinct_count") > max_values)


def values_summary(df: DataFrame, column: str, max_values: int | None = None) -> DataFrame:
    """One row: total rows, nulls, distinct values, and whether a listing is cut."""
    return _totals(_grouped(df, column), max_values)


def distinct_values(
    df: DataFrame, column: str, max_values: int | None = None, sort: str = "value"
) -> DataFrame:
    """All distinct values, or the ``max_values`` most frequent, with their counts and the
    column totals.

    The rows are grouped once; the totals read the same grouped rows.  ``sort`` is
    ``"value"`` (by text form, so numbers sort as text) or ``"frequency"``.
    """
    if sort not in ("value", "frequency"):
        raise ValueError(f"sort must be 'value' or 'frequency', got {sort!r}")
    grouped = _grouped(df, column)
    totals = _totals(grouped, max_values).select(F.struct("*")).scalar()
    if max_values is not None:
        # Null sorts behind every value, so the limit comes first and the grouped rows
        # stay the same for the listing and the totals.
        grouped = grouped.orderBy(F.col("value").isNull(), F.desc("n"), "value"
                                  ).limit(max_values)
    listed = (
        grouped.where(F.col("value").isNotNull())
        .withColumn("_t", totals)
        .select("value", F.col("n").alias("count"), "_t.*")
    )
    if sort == "frequency":
        return listed.orderBy(F.desc("count"), "value")
    return listed.orderBy(F.col("value").cast("string"))


# Candidates of a column for its most frequent values, and hash classes of all its others.
_CANDIDATES = 200
_CLASSES = 4_096


def _candidates(df: DataFrame, names: Sequence[str], wanted: int) -> DataFrame:
    """``(pos, slots)``: the values a sketch finds frequent, a few per column.

    Types that the sketch does not take have none.
    """
    used = counts.slots(df, names)

    def found(name: str) -> str:
        dt = df.schema[name].dataType
        if not can_be_tracked(dt):
            return f"cast(array() as array<{used[counts.slot_name(dt)]}>)"
        value = f"cast({sql_name(name)} as {used[counts.slot_name(dt)]})"
        return (f"transform(filter(approx_top_k({value}, {wanted + 1}, {TRACKED_VALUES}), "
                "s -> s.item is not null), s -> s.item)")

    def entry(i: int, name: str) -> str:
        own = counts.slot_name(df.schema[name].dataType)
        rows = ", ".join(f"'{slot}', " + ("v" if slot == own else f"cast(null as {kind})")
                         for slot, kind in used.items())
        return sql_struct({"found": f"transform({found(name)}, "
                           f"v -> named_struct('pos', {i}, {rows}))"})

    return per_column(df, names, entry).select(F.inline("found"))


def settled_counts(df: DataFrame, names: Sequence[str], top: int
                   ) -> tuple[DataFrame, DataFrame]:
    """Exact counts of candidates, and the columns whose first ``top`` values they prove.

    One scan finds candidates, a second one counts them exactly, and counts all other
    values by hash class. No other value can occur more often than its class, so a column
    is settled if its ``top``-th candidate occurs more often than the largest class. What
    is shuffled is a row per candidate and class from every task, whatever values there are.
    Returns ``(pos, slots, n)`` with the null group, and one row per settled column.
    """
    used = list(counts.slots(df, names))
    # Hashes tell candidates: a value that shares one is counted exactly as well. Two
    # numbers a candidate, a bounded number of candidates a column.
    marked = F.broadcast(written(_candidates(df, names, max(_CANDIDATES, 2 * top)).select(
        "pos", F.xxhash64(*used).alias("hash")).distinct(), "candidates").withColumn(
        "chosen", F.lit(True)))
    missing = reduce(lambda a, b: a & b, [F.col(s).isNull() for s in used])
    rows = counts.unfolded(df, names).withColumn("hash", F.xxhash64(*used))
    own = F.coalesce("chosen", missing)  # null has a row of its own
    classes = F.when(~own, F.pmod("hash", F.lit(_CLASSES)))
    counted = written(rows.join(marked, ["pos", "hash"], "left").groupBy(
        "pos", *(F.when(own, F.col(s)).alias(s) for s in used), classes.alias("class")).agg(
        F.count(F.lit(1)).alias("n")), "settled")
    exact = counted.where("class is null").drop("class")
    present = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in used])
    largest = counted.groupBy("pos").agg(F.max(F.when(F.col("class").isNotNull(), F.col("n"))
                                               ).alias("largest"))
    nth = counts.first_per_group(exact.where(present), ["pos"], [F.desc("n")], top).groupBy(
        "pos").agg(F.max("rank_in_group").alias("ranks"), F.min("n").alias("least"))
    settled = largest.join(nth, "pos", "left").where(
        F.col("largest").isNull() | ((F.col("ranks") == top)
                                     & (F.col("least") > F.col("largest"))))
    return exact, settled.select("pos")


def top_values(
    source: DataFrame | Scan, columns: Sequence[str] | str | None = None, top: int = 10
) -> DataFrame:
    """The most frequent values of every column, as text, and exactly.

    ``non_null_rows`` is the total behind the listed counts; ``total_rows`` also
    counts the nulls. Columns where a sketch's candidates are proved to win are counted
    without grouping their other values; only the columns left are grouped whole.
    """
    df = _data(source)
    names = pick_columns(df, columns)
    used = counts.slots(df, names)
    exact, settled = settled_counts(df, names, top)
    sure = sorted(r["pos"] for r in settled.collect())  # one number per column
    left = [c for i, c in enumerate(names) if i not in sure]
    parts = []
    if sure:
        parts.append(exact.where(F.col("pos").isin(sure)).select(
            "pos", counts.name_at(names).alias("column_name"),
            counts.text_of(used).alias("value"), "n"))
    if left:
        places = F.element_at(F.lit([names.index(c) for c in left]), F.col("pos") + 1)
        parts.append(counts.text_counts(df, left).withColumn("pos", places))
    counted = reduce(DataFrame.unionByName, parts)
    totals = per_column(df, names, lambda i, c: sql_struct({
        "pos": str(i), "total_rows": "count(1)",
        "null_count": f"count(1) - count({sql_name(c)})"}))
    ranked = counts.first_per_group(
        counted.where(F.col("value").isNotNull()), ["pos"], [F.desc("n"), F.col("value")], top)
    return ranked.join(totals, "pos").select(
        "pos", "column_name", F.col("rank_in_group").alias("rank"), "value",
        F.col("n").alias("count"),
        (F.col("total_rows") - F.col("null_count")).alias("non_null_rows"),
        "total_rows", "null_count",
    )


def sample_values(df: DataFrame, columns: Sequence[str] | str | None = None,
                  limit: int = 25) -> DataFrame:
    """Up to ``limit`` distinct non-null values per column, first in text order.

    One scan takes the least value of each of many hash classes: the ``limit``-th of these
    bounds what can be listed. A second scan groups only the values up to that bound, about
    as many as are listed, so nothing else is shuffled, however many values there are.
    """
    names = pick_columns(df, columns)
    used = counts.slots(df, names)
    valued = counts.unfolded(df, names).select(
        "pos", counts.text_of(used).alias("value")).where(F.col("value").isNotNull())
    classes = max(_CLASSES // 4, limit * limit)
    least = valued.groupBy("pos", F.pmod(F.xxhash64("value"), F.lit(classes)).alias("class")
                           ).agg(F.min("value").alias("value")).drop("class")
    # Where there are fewer classes with values than asked for, there is no bound.
    bounds = written(counts.first_per_group(least, ["pos"], [F.col("value")], limit).groupBy(
        "pos").agg(F.when(F.count(F.lit(1)) == limit, F.max("value")).alias("bound")), "bounds")
    # One row per column; Spark broadcasts it by itself while its values are short.
    near = valued.join(bounds, "pos").where(
        F.col("bound").isNull() | (F.col("value") <= F.col("bound")))
    listed = near.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.first_per_group(listed, ["pos"], [F.col("value")], limit).select(
        "pos", counts.name_at(names).alias("column_name"), "value",
        F.col("rank_in_group").alias("rank")
    )


def histogram(source: DataFrame | Scan, column: str, buckets: int = 20) -> DataFrame:
    """Equal-width buckets of a numeric column.

    The last bucket includes the maximum, empty buckets are left out, a constant
    column has the single bucket 0.  NaN and infinities have no place on the axis and
    count as null.
    """
    df = _data(source)
    name = pick_column(df, column)
    x = as_number(name, df.schema[name].dataType)
    edges = df.agg(F.struct(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("total_rows"),
        (F.count(F.lit(1)) - F.count(x)).alias("null_count"))).scalar()
    placed = df.select(x.alias("x"), edges.alias("e")).where(F.col("x").isNotNull())
    lo, hi = F.col("e.lo"), F.col("e.hi")
    bucket = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - lo) * buckets / (hi - lo)), F.lit(buckets - 1)))
    width = (hi - lo) / buckets
    start = lo + F.col("bucket") * width
    end = F.when(F.col("bucket") == buckets - 1, hi).otherwise(
        lo + (F.col("bucket") + 1) * width)
    return (
        placed.groupBy(bucket.cast("bigint").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("e", edges)
        .select("bucket", start.alias("bucket_min"), end.alias("bucket_max"), "count",
                "e.total_rows", "e.null_count")
        .orderBy("bucket")
    )


def categories(source: DataFrame | Scan, column: str, top: int = 20) -> DataFrame:
    """Most frequent values of one column and their share of the listed rows."""
    df = _data(source)
    listed = distinct_values(df, column, top, "frequency")
    return listed.select(
        F.col("value").cast("string").alias("value"), "count",
        exact_round(share(F.col("count"), F.sum("count").over(Window.partitionBy())), 1
                    ).alias("listed_pct"),
        (F.col("total_rows") - F.col("null_count")).alias("non_null_rows"),
        "total_rows", "null_count",
    )


def distribution(source: DataFrame | Scan, column: str, buckets: int = 20,
                 top: int = 20) -> DataFrame:
    """Histogram of a numeric column, top values of any other."""
    df = _data(source)
    name = pick_column(df, column)
    if is_numeric(df.schema[name].dataType):
        return histogram(df, name, buckets)
    return categories(df, name, top)
