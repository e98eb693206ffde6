"""Column statistics of a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from ..functions.numbers import share, sql_round
from ..functions.types import (
    as_number, is_floating, is_nested, is_numeric, is_orderable, sql_length, sql_name,
    sql_number, sql_struct, sql_text,
)
from ..sources.rows import pick_columns
from ..sources.sampling import Scan
from . import counts

# Distinct values a frequency sketch can track.
TRACKED_VALUES = 10_000
# Wide tables are aggregated in batches so that the generated code stays small enough to
# be compiled; the number of batches is bounded because each one reads the table's files.
BATCH_COLUMNS = 8
MAX_BATCHES = 16
# Rank error of the percentile sketch is 1 / accuracy; the bracket around the median
# is kept wider than that.
_ACCURACY = 10_000
# Rank error of the median sketch is below a thousandth at this size.
_SKETCH_SIZE = 4_000
# Size of the distinct sketch: a unique key stays above the high-cardinality share.
_DISTINCT_BITS = 14
_BRACKET = (0.5 - 3 / _ACCURACY, 0.5 + 3 / _ACCURACY)
_STEPS = 1000


def clamp_distinct(distinct: Column, rows: Column) -> Column:
    """Sketches may overshoot; never report more distinct values than rows."""
    return F.greatest(F.least(distinct, rows), F.lit(0))


NO_EXTREMES = {
    "min_val": "cast(null as double)", "max_val": "cast(null as double)",
    "min_text": "cast(null as string)", "max_text": "cast(null as string)",
}


def extremes(name: str, dt: T.DataType) -> dict[str, str]:
    """min and max as double for numbers, as text for everything that prints exactly."""
    c, found = sql_name(name), dict(NO_EXTREMES)
    for f in ("min", "max"):
        if is_numeric(dt):
            found[f"{f}_val"] = f"cast({f}({c}) as double)"
        if is_orderable(dt) and not is_floating(dt):
            found[f"{f}_text"] = f"cast({f}({c}) as string)"
    return found


def per_column(df: DataFrame, columns: Sequence[str],
               entry: Callable[[int, str], str | Column],
               batch_columns: int | None = None) -> DataFrame:
    """One aggregate struct per column, computed batch by batch and unfolded to rows.

    Entries are SQL text, which is far quicker to turn into a plan than columns built
    call by call.
    """
    if batch_columns is None:
        batches = min(MAX_BATCHES, math.ceil(len(columns) / BATCH_COLUMNS))
        batch_columns = math.ceil(len(columns) / batches)
    parts = []
    for start in range(0, len(columns), batch_columns):
        items = [entry(start + i, c)
                 for i, c in enumerate(columns[start:start + batch_columns])]
        if all(isinstance(i, str) for i in items):
            found = F.expr(f"array({', '.join(items)})")
        else:
            found = F.array(*[F.expr(i) if isinstance(i, str) else i for i in items])
        parts.append(df.agg(found.alias("items")).select(F.inline("items")))
    return reduce(DataFrame.unionByName, parts)


def described(rows: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``pos`` get the name and type of their column."""
    def listed(values: list[str]) -> Column:
        return F.element_at(F.lit(values), F.col("pos") + 1)

    return rows.withColumns({
        "column_name": listed(list(columns)),
        "column_type": listed([df.schema[c].dataType.simpleString() for c in columns])})


def _column_stats(df: DataFrame, pos: int, name: str, quick: bool, top: int = 0) -> str:
    dt = df.schema[name].dataType
    fields = {"pos": str(pos), "total_rows": "count(1)",
              "non_null": f"count({sql_name(name)})"}
    if quick:
        return sql_struct(fields)
    if top:
        fields["some_values"] = ("cast(null as array<string>)" if is_numeric(dt)
                                 else some_values(name, dt, top))
    if is_numeric(dt):
        x, none = sql_number(name, dt), "cast(null as bigint)"
        fields |= extremes(name, dt)
        fields |= {"mean_val": f"avg({x})", "stddev_val": f"stddev({x})",
                   "min_length": none, "max_length": none}
    else:
        length, none = sql_length(name, dt), "cast(null as double)"
        fields |= NO_EXTREMES
        fields |= {"mean_val": none, "stddev_val": none,
                   "min_length": f"cast(min({length}) as bigint)",
                   "max_length": f"cast(max({length}) as bigint)"}
    return sql_struct(fields)


def _sketches(df: DataFrame, pos: int, name: str, quick: bool, top: int) -> str:
    dt = df.schema[name].dataType
    fields = {"pos": str(pos), "distinct_count": approx_distinct(name, dt)}
    if not quick:
        fields["median_val"] = (approx_median(sql_number(name, dt)) if is_numeric(dt)
                                else "cast(null as double)")
    if top:
        fields["listed"] = (
            "cast(null as array<struct<value:string,count:bigint>>)" if is_numeric(dt)
            else top_sketch(name, dt, top, TRACKED_VALUES))
    return sql_struct(fields)


def distinct_sketch(name: str, dt: T.DataType) -> str:
    """SQL for the distinct sketch of a column, which can be stored and united.

    Whole numbers and texts count as they are, other values by their text.
    """
    value = sql_name(name) if is_orderable(dt) and not is_nested(dt) else sql_text(name, dt)
    if isinstance(dt, T.IntegralType):
        value = f"cast({value} as bigint)"
    elif not isinstance(dt, (T.StringType, T.BinaryType)):
        value = sql_text(name, dt)
    return f"hll_sketch_agg({value}, {_DISTINCT_BITS})"


def approx_distinct(name: str, dt: T.DataType) -> str:
    """SQL for the number of distinct values, from a sketch whose error is below one percent.

    The extremes settle what decisions hang on: one value is told from two exactly.
    """
    value = sql_name(name) if is_orderable(dt) and not is_nested(dt) else sql_text(name, dt)
    return (f"greatest(hll_sketch_estimate({distinct_sketch(name, dt)}), "
            f"if(min({value}) < max({value}), 2L, 0L))")


def quantile_sketch(x: str) -> str:
    """SQL for the quantile sketch of a number, which can be stored and merged; or null."""
    return f"if(count({x}) > 0, kll_sketch_agg_double({x}, {_SKETCH_SIZE}), null)"


def approx_median(x: str) -> str:
    """SQL for the median from a KLL sketch; null without values."""
    return (f"if(count({x}) > 0, kll_sketch_get_quantile_double("
            f"kll_sketch_agg_double({x}, {_SKETCH_SIZE}), 0.5D), null)")


def can_be_tracked(dt: T.DataType) -> bool:
    """Whether a frequency sketch takes values of a type: no intervals and no nested types."""
    return is_orderable(dt) and "interval" not in dt.typeName()


def _countable(name: str, dt: T.DataType) -> str:
    return sql_name(name) if can_be_tracked(dt) else sql_text(name, dt)


def some_values(name: str, dt: T.DataType, top: int) -> str:
    """SQL for up to ``top`` different values: the least of each of as many hash classes."""
    value = _countable(name, dt)
    least = ", ".join(f"min(if(pmod(xxhash64({value}), {top}) = {i}, {value}, null))"
                      for i in range(top))
    return f"array_sort(transform(array_compact(array({least})), v -> cast(v as string)))"


def count_error(non_null: Column, distinct: Column, tracked: int = TRACKED_VALUES) -> Column:
    """How far counts of a frequency sketch may be off: nothing while all values fit."""
    slots = 1 << math.ceil(math.log2(tracked / 0.75))
    return F.when(distinct < tracked // 2, F.lit(0)).otherwise(
        F.ceil(non_null * F.lit(3.5 / slots))).cast("bigint")


def certified(listed: Column, some: Column, non_null: Column, distinct: Column, top: int
              ) -> tuple[Column, Column]:
    """Values of a sketch with their counts, and whether they are proved to be all.

    They are all if there are as many as different values, and their counts add up to all
    rows with a value: a sketch that had to give up any value would fail the first, one
    that still holds all counts exactly, so that the second holds only for the whole set.
    Where the sketch is sure of fewer than ``top`` values, as on long tails and keys, any
    others fill up, with the count of one that is known of them.
    """
    proved = (F.size(listed) == distinct) & (
        F.aggregate(listed, F.lit(0).cast("bigint"), lambda n, v: n + v["count"]) == non_null)
    known = F.transform(listed, lambda v: v["value"])
    others = F.transform(F.array_except(some, known), lambda v: F.struct(
        v.alias("value"), F.lit(1).cast("bigint").alias("count")))
    return F.slice(F.concat(listed, others), 1, top), proved


def top_sketch(name: str, dt: T.DataType, top: int, tracked: int) -> str:
    """SQL for the most frequent non-null values with estimated counts, from a sketch.

    A sketch lists only values that it is sure are frequent, so there may be none.
    """
    value = _countable(name, dt)
    # The sketch ranks null like a value, so one more item is asked for.
    return (f"transform(slice(filter(approx_top_k({value}, {top + 1}, {tracked}), "
            f"s -> s.item is not null), 1, {top}), "
            "s -> named_struct('value', cast(s.item as string), 'count', s.count))")


def _present(used: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(1)) for s in used])


def exact_distincts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(pos, distinct_count)`` from grouped values."""
    used = counts.slots(df, columns)
    return (
        counts.value_counts(df, columns)
        .groupBy("pos")
        .agg(F.count(_present(used)).alias("distinct_count"))
    )


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(pos, distinct_count, median_val)`` without bringing a column into one task.

    A percentile sketch brackets the median.  All values are counted once for distinct
    counts and the ranks below the bracket; the few values inside it are cut into steps
    of equally many values, and only the steps that hold a middle rank are put in order.
    """
    numeric = {i: c for i, c in enumerate(columns) if is_numeric(df.schema[c].dataType)}
    if not numeric:
        return exact_distincts(df, columns).withColumn(
            "median_val", F.lit(None).cast("double"))

    low_share, high_share = _BRACKET
    sketched = per_column(df, list(numeric.values()), lambda i, c: sql_struct({
        "item": str(i),
        "edges": f"approx_percentile({sql_number(c, df.schema[c].dataType)}, "
                 f"array({low_share}D, {high_share}D), {_ACCURACY})"}))
    brackets = sketched.select(
        F.element_at(F.lit(list(numeric)), F.col("item") + 1).alias("pos"),
        F.col("edges")[0].alias("low"), F.col("edges")[1].alias("high"))
    used = counts.slots(df, columns)
    number = counts.number_of(used)
    valued = counts.value_counts(df, columns).select(
        "pos", "n", _present(used).alias("present"),
        F.when(F.abs(number) < F.lit(float("inf")), number).alias("x"),
    ).join(brackets, "pos", "left")  # one bracket per column
    x, low, high = F.col("x"), F.col("low"), F.col("high")

    # Every use of the counted values keeps ``n``, so they are shuffled once.
    once = F.when(F.col("present").isNotNull(), F.least(F.col("n"), F.lit(1)))
    sizes = valued.groupBy("pos").agg(
        F.coalesce(F.sum(once), F.lit(0)).alias("distinct_count"),
        F.sum(F.when(x.isNotNull(), F.col("n"))).alias("total"),
        F.coalesce(F.sum(F.when(x < low, F.col("n"))), F.lit(0)).alias("below"),
    ).withColumns({"lower_rank": F.floor((F.col("total") + 1) / 2),
                   "upper_rank": F.ceil((F.col("total") + 1) / 2)})

    def running(*group: str) -> WindowSpec:
        return Window.partitionBy(*group).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)

    # The condition names ``n``, so it stays behind the counting, and the counted values
    # are read again instead of the table.
    within = F.when((x >= low) & (x <= high), F.col("n"))
    bracketed = valued.where(F.coalesce(within, F.lit(0)) > 0).groupBy("pos", "x").agg(
        F.sum("n").alias("n"))
    # Steps hold equally many different values wherever those lie, so no window is large.
    marks = ", ".join(f"{i / _STEPS}D" for i in range(1, _STEPS))
    edges = bracketed.groupBy("pos").agg(
        F.expr(f"approx_percentile(x, array({marks}), {_ACCURACY})").alias("edges"))
    step = F.size(F.filter("edges", lambda e: e < F.col("x")))
    inside = bracketed.join(edges, "pos").select("pos", step.alias("step"), "x", "n")
    steps = (
        inside.groupBy("pos", "step").agg(F.sum("n").alias("step_n"))
        .withColumn("upto", F.sum("step_n").over(running("pos").orderBy("step")))
        .join(sizes.drop("distinct_count"), "pos")
        .select("pos", "step", "lower_rank", "upper_rank",
                (F.col("below") + F.col("upto") - F.col("step_n")).alias("before"),
                (F.col("below") + F.col("upto")).alias("upto"))
        .where((F.col("upto") >= F.col("lower_rank"))
               & (F.col("before") < F.col("upper_rank")))
    )
    ranked = inside.join(steps, ["pos", "step"]).withColumn(
        "reached", F.col("before") + F.sum("n").over(running("pos", "step").orderBy("x")))
    medians = ranked.groupBy("pos").agg(
        ((F.min(F.when(F.col("reached") >= F.col("lower_rank"), x))
          + F.min(F.when(F.col("reached") >= F.col("upper_rank"), x))) / 2
         ).alias("median_val"))
    return sizes.select("pos", "distinct_count").join(medians, "pos", "left")


_FULL = ("column_name", "column_type", "total_rows", "null_count", "null_pct",
         "distinct_count", "min_val", "max_val", "min_text", "max_text", "mean_val",
         "median_val", "stddev_val", "min_length", "max_length")
_QUICK = _FULL[:6]


def profile(
    source: DataFrame | Scan,
    columns: Sequence[str] | str | None = None,
    exact: bool = False,
    quick: bool = False,
    batch_columns: int | None = None,
    top: int = 0,
) -> DataFrame:
    """One row of statistics per column, in table order (``pos``).

    The default uses sketches for distinct counts and medians; nothing but a few bytes
    per column is shuffled.  ``exact`` groups the values instead.  Extremes of floating
    columns keep NaN and infinities, which the other statistics skip; medians of integers
    beyond 2^53 are rounded to a double.  ``quick`` keeps null
    and distinct counts only.
    A sampled ``Scan`` reports the true ``row_count`` next to the scanned rows.
    ``top`` adds the most frequent values of non-numeric columns, from a sketch in the
    sketch pass, and ``all_values``, whether those are proved to be all; it needs
    ``exact=False``. Long tails are filled up with any values.
    """
    scan = source if isinstance(source, Scan) else Scan(source)
    df = scan.data
    names = pick_columns(df, columns)
    if top and exact:
        raise ValueError("top belongs to the sketched profile; use top_values() instead")
    # Plain aggregates compile to one loop, sketches do not; kept apart, the plain ones
    # stay fast, and reading the columns twice costs less than interpreting them once.
    stats = per_column(df, names, lambda i, c: _column_stats(df, i, c, quick, top),
                       batch_columns)
    if exact:
        second = (exact_distincts if quick else exact_medians)(df, names)
    else:
        second = per_column(df, names, lambda i, c: _sketches(df, i, c, quick, top),
                            batch_columns)
    stats = stats.join(second, "pos", "left")
    nulls = F.col("total_rows") - F.col("non_null")
    stats = described(stats, df, names).withColumns({
        "null_count": nulls, "null_pct": sql_round(share(nulls, F.col("total_rows")), 2),
        "distinct_count": clamp_distinct(
            F.coalesce("distinct_count", F.lit(0)), F.col("total_rows"))})
    if top:
        values, proved = certified(F.col("listed"), F.col("some_values"), F.col("non_null"),
                                   F.col("distinct_count"), top)
        stats = stats.withColumns({
            "top_values": F.transform(values, lambda v: v["value"]), "all_values": proved})
    if not quick:
        stats = stats.withColumns({
            c: sql_round(F.col(c), 4) for c in ("mean_val", "stddev_val")})
    true_rows = (F.lit(scan.row_count).cast("bigint") if scan.sampled
                 else F.col("total_rows"))
    return stats.select(
        "pos", *(_QUICK if quick else _FULL), true_rows.alias("row_count"),
        F.lit(scan.sampled).alias("sampled"), *(["top_values", "all_values"] if top else []),
    )


def approx_top_values(df: DataFrame, columns: Sequence[str] | str | None = None,
                      top: int = 5, tracked: int = TRACKED_VALUES) -> DataFrame:
    """Most frequent values per column from a sketch: one scan, no shuffle of values.

    Every column has rows. Where the sketch is sure of fewer values than asked for, any
    others follow with a count of at least one; a column without values has one row with
    a null value. Counts are right within ``max_error``, which is nothing while all values
    fit the sketch; ``all_values`` says that the listed ones are proved to be all.
    ``null_count`` and ``total_rows`` are exact.
    """
    names = pick_columns(df, columns)

    def entry(i: int, name: str) -> str:
        dt = df.schema[name].dataType
        return sql_struct({
            "pos": str(i), "total_rows": "count(1)", "non_null": f"count({sql_name(name)})",
            "distinct": approx_distinct(name, dt), "some": some_values(name, dt, top),
            "listed": top_sketch(name, dt, top, tracked)})

    rows = per_column(df, names, entry)
    values, proved = certified(F.col("listed"), F.col("some"), F.col("non_null"),
                               F.col("distinct"), top)
    return described(rows, df, names).select(
        "pos", "column_name", "total_rows",
        (F.col("total_rows") - F.col("non_null")).alias("null_count"),
        count_error(F.col("non_null"), F.col("distinct"), tracked).alias("max_error"),
        proved.alias("all_values"), F.inline_outer(values))
