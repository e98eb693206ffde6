"""Select, filter, sort, preview, cap and export rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.types import as_text, is_nested, ref

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def check_name(name: str) -> str:
    """Refuse names that are not plain identifiers before they enter SQL text."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a valid table or column name: {name!r}")
    return name


def pick_columns(df: DataFrame, names: Sequence[str] | str | None) -> list[str]:
    """Canonical spelling of the wanted columns, in table order.

    Names match in any case; unknown names are dropped and an empty match is an error.
    """
    if not names:
        return df.columns
    if isinstance(names, str):
        names = names.split(",")
    wanted = {n.strip().lower() for n in names if n.strip()}
    found = [c for c in df.columns if c.lower() in wanted]
    if not found:
        raise ValueError(
            "no matching columns; available columns: " + ", ".join(df.columns))
    return found


def pick_column(df: DataFrame, name: str) -> str:
    return pick_columns(df, [name])[0]


def select_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: str | Column | None = None,
    order_by: Sequence[Column | str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Columns, a free WHERE expression, an order and a limit, all optional."""
    if where is not None:
        df = df.where(where)
    if order_by:
        df = df.orderBy(*order_by)
    if limit:
        df = df.limit(limit)
    if columns:
        df = df.select(*[ref(c) for c in pick_columns(df, columns)])
    return df


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by one column: nulls last ascending, first descending."""
    c = ref(pick_column(df, column))
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last())


def preview(df: DataFrame, limit: int = 20,
            order_by: Sequence[Column | str] | None = None) -> DataFrame:
    """The first rows of a table; give an order to make them repeatable."""
    return select_rows(df, order_by=order_by, limit=limit)


def scratch(df: DataFrame, name: str, rows: int,
            order_by: Sequence[Column | str] | None = None) -> DataFrame:
    """The first rows as a temporary view ``tmp_<name>`` to experiment on."""
    view = "tmp_" + check_name(name).split(".")[-1]
    preview(df, rows, order_by).createOrReplaceTempView(view)
    return df.sparkSession.table(view)


def capped_query(spark: SparkSession, sql: str, limit: int = 0) -> DataFrame:
    """Any SELECT, whole or under an outer row limit; 0 is no limit."""
    df = spark.sql(sql.rstrip().rstrip(";"))
    return df.limit(limit) if limit > 0 else df


def capped_query_summary(spark: SparkSession, sql: str, limit: int = 0) -> DataFrame:
    """Rows returned by a capped query and whether the limit was reached."""
    counted = capped_query(spark, sql, limit).agg(F.count(F.lit(1)).alias("row_count"))
    reached = F.col("row_count") >= limit if limit > 0 else F.lit(False)
    return counted.withColumn("limited", reached)


def export(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    columns: Sequence[str] | None = None,
    where: str | Column | None = None,
    limit: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write rows as csv, tsv, json or jsonl, one file per partition.

    ``json`` and ``jsonl`` both write one JSON object per line.  Nested and binary
    values become text in the delimited formats.
    """
    rows = select_rows(df, columns, where, limit=limit)
    if fmt in ("json", "jsonl"):
        rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
        return
    if fmt not in ("csv", "tsv"):
        raise ValueError(f"unsupported export format: {fmt!r}")
    flat = rows.select(*[
        (as_text(f.name, f.dataType) if is_nested(f.dataType)
         or f.dataType.typeName() == "binary" else ref(f.name)).alias(f.name)
        for f in rows.schema.fields
    ])
    (
        flat.write.mode(mode)
        .option("header", "true")
        .option("sep", "," if fmt == "csv" else "\t")
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def export_query(spark: SparkSession, sql: str, path: str, fmt: str = "csv",
                 limit: int | None = None) -> None:
    """Write the result of a SELECT."""
    export(capped_query(spark, sql, limit or 0), path, fmt)
