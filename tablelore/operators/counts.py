"""Value counts of many columns in one scan and one shuffle.

The columns are unfolded into rows ``(pos, typed value)`` and grouped.  Counting
before the shuffle turns a value held by a third of all rows into one row per task.
Each type keeps its own slot, so numbers group as numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.types import is_nested, is_text, sql_name, sql_struct

# Spark prunes a ranked group to its first rows before the shuffle up to this rank.
_PRUNED_RANK = 1000
_SALTS = 64
# Columns unfolded per pass over the table; all passes meet in one shuffle.
_BATCH = 25


def _slot(dt: T.DataType) -> tuple[str, str]:
    """Name and type of the slot that holds values of a type without loss."""
    if isinstance(dt, T.IntegralType):
        return "v_bigint", "bigint"
    if is_text(dt) or is_nested(dt) or "interval" in dt.typeName():
        return "v_text", "string"
    kind = dt.simpleString()
    return "v_" + "".join(ch if ch.isalnum() else "_" for ch in kind), kind


def slot_name(dt: T.DataType) -> str:
    return _slot(dt)[0]


def _slot_value(name: str, dt: T.DataType) -> str:
    if is_nested(dt):
        return f"to_json({sql_name(name)})"
    return f"cast({sql_name(name)} as {_slot(dt)[1]})"


def slots(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return dict(_slot(df.schema[c].dataType) for c in columns)


def unfolded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(pos, one slot per type)``: a row for every value of every column."""
    used = slots(df, columns)

    def entry(pos: int, name: str) -> str:
        own = _slot(df.schema[name].dataType)[0]
        return sql_struct({"pos": str(pos), **{
            slot: _slot_value(name, df.schema[name].dataType) if slot == own
            else f"cast(null as {kind})" for slot, kind in used.items()}})

    entries = [entry(i, c) for i, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, [
        df.selectExpr(f"inline(array({', '.join(entries[i:i + _BATCH])}))")
        for i in range(0, len(entries), _BATCH)
    ])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(pos, one slot per type, n)``; all slots null is the null group of a column."""
    return unfolded(df, columns).groupBy("pos", *slots(df, columns)).agg(
        F.count(F.lit(1)).alias("n"))


def text_of(used: dict[str, str]) -> Column:
    """The value of a row as text, null for the null group."""
    return F.coalesce(*[
        F.hex(s) if t == "binary" else F.col(s).cast("string") for s, t in used.items()
    ])


def number_of(used: dict[str, str]) -> Column:
    """The value of a row as double, null when it is not a number."""
    numeric = [s for s, t in used.items()
               if t in ("bigint", "double", "float") or t.startswith("decimal")]
    if not numeric:
        return F.lit(None).cast("double")
    return F.coalesce(*[F.col(s).cast("double") for s in numeric])


def name_at(columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1)


def text_counts(df: DataFrame, columns: Sequence[str],
                only: DataFrame | None = None) -> DataFrame:
    """``(pos, column_name, value as text, n)`` including one null row per column.

    With ``only``, a small table of ``column_name`` and ``value``, just the values in it are
    counted, and all others are left out before anything is grouped or shuffled; a null
    there asks for nothing.
    """
    used = slots(df, columns)
    if only is None:
        counted = value_counts(df, columns)
    else:
        wanted = F.broadcast(only.select("column_name", "value").dropna().distinct())
        counted = unfolded(df, columns).withColumns(
            {"column_name": name_at(columns), "value": text_of(used)}).join(
            wanted, ["column_name", "value"], "left_semi").groupBy("pos", *used).agg(
            F.count(F.lit(1)).alias("n"))
    return counted.select(
        "pos", name_at(columns).alias("column_name"), text_of(used).alias("value"), "n"
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    n: int) -> DataFrame:
    """The first ``n`` rows of every group, with ``rank_in_group`` from 1.

    Every task cuts its part of a group to ``n`` rows before the shuffle.  Spark does
    that by itself for small ``n``; for larger ``n`` a salted first round does it.
    """
    final = Window.partitionBy(*group).orderBy(*order)
    if n > _PRUNED_RANK:
        salted = Window.partitionBy(*group, "_salt").orderBy(*order)
        salts = max(_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]),
                                          F.lit(salts)))
            .withColumn("_r", F.row_number().over(salted))
            .where(F.col("_r") <= n)
            .drop("_r", "_salt")
        )
    return df.withColumn("rank_in_group", F.row_number().over(final)).where(
        F.col("rank_in_group") <= n
    )
