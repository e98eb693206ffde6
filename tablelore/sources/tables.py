"""Open tables, list them, describe their columns and count their rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.text import has_content

CATALOG_SCHEMA = (
    "table_name string, ordinal int, column_name string, data_type string, "
    "nullable boolean, comment string"
)


def open_parquet(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Read a Parquet file or folder and register it as a view named by its stem."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view or PurePosixPath(path.rstrip("/")).stem)
    return df


def open_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: open_parquet(spark, path, name) for name, path in paths.items()}


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views the session knows, ordered by name."""
    found = spark.catalog.listTables(database)
    rows = [(t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table")
            for t in found]
    return spark.createDataFrame(rows, "table_name string, table_type string").orderBy(
        "table_name"
    )


def column_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of every table, read from the schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (table, i, f.name, f.dataType.simpleString(), f.nullable,
         (f.metadata or {}).get("comment"))
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def row_count(df: DataFrame) -> DataFrame:
    """Exact row count as one row; Parquet answers it from file footers."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row counts of many tables, one row each."""
    counts = [
        row_count(df).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def row_counts_of(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Exact row counts of Parquet tables by the paths of their files or folders.

    One scan reads no column of all of them, counts rows per file (footers have the
    numbers) and adds them up for the folders above, so thousands of tables make one plan
    of bounded size. Folders in a table's folder belong to it; one named twice counts for
    both names, and a table without files has no rows.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).makeQualified(at).toUri().toString()

    names = spark.createDataFrame([(n, whole(p)) for n, p in paths.items()],
                                  "table_name string, folder string")
    # Folders of different tables share no partition columns; only their files count.
    rows = (spark.read.schema(StructType([])).option("recursiveFileLookup", True)
            .parquet(*sorted(set(paths.values()))))
    per_file = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"))
    def address(name: str) -> Column:  # file:/// and file:/ are both in use
        return F.regexp_replace(name, "^(file:)/+", "$1/")

    names = names.withColumn("folder", address("folder"))
    parts = F.split(address("file"), "/")
    above = per_file.select("n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder"))
    per_folder = names.select("folder").distinct().join(above, "folder").groupBy(
        "folder").agg(F.sum("n").alias("n"))
    return names.join(per_folder, "folder", "left").select(
        "table_name", F.coalesce("n", F.lit(0)).alias("row_count"))


def inspect(df: DataFrame, name: str) -> DataFrame:
    """Columns of one table next to its exact row count."""
    return column_catalog({name: df}).withColumn(
        "row_count", row_count(df).scalar()
    )


def catalog(tables: Mapping[str, DataFrame], tables_only: bool = False) -> DataFrame:
    """All tables with their columns and row counts.

    ``tables_only`` lists the names and leaves columns and counts null.
    """
    columns = column_catalog(tables)
    if tables_only:
        return columns.select("table_name").distinct().select(
            "table_name",
            *[F.lit(None).cast(t).alias(c) for c, t in (
                ("ordinal", "int"), ("column_name", "string"), ("data_type", "string"),
                ("nullable", "boolean"), ("comment", "string"), ("row_count", "bigint"))],
        )
    return columns.join(row_counts(tables), "table_name", "left")


def search_catalog(catalog_rows: DataFrame, pattern: str) -> DataFrame:
    """Keep every row of a table whose name or any column name contains the pattern."""
    wanted = F.lit(pattern.lower())
    hits = (
        catalog_rows.where(
            F.contains(F.lower("table_name"), wanted)
            | F.contains(F.lower("column_name"), wanted)
        )
        .select("table_name")
        .distinct()
    )
    return catalog_rows.join(hits, "table_name", "left_semi")


def enrich_catalog(catalog_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach the stored descriptions to catalog rows; placeholders are left out.

    ``facts`` holds current facts, one row per table, column and field.
    """
    shown = F.when(has_content("value"), F.trim("value"))

    def field(name: str):
        return F.max(F.when(F.col("field") == name, shown)).alias(name)

    per_table = (
        facts.where(F.col("column_name").isNull()
                    & F.col("field").isin(*fixed.HUMAN_TABLE_FIELDS))
        .groupBy("table_name")
        .agg(*[field(f) for f in fixed.HUMAN_TABLE_FIELDS])
    )
    per_column = (
        facts.where(F.col("column_name").isNotNull()
                    & F.col("field").isin(*fixed.HUMAN_COLUMN_FIELDS))
        .groupBy("table_name", F.lower("column_name").alias("column_key"))
        .agg(
            field("description"),
            field("pii"),
            F.max(F.when((F.col("field") == "valid_values") & (F.size("values") > 0),
                         F.col("values"))).alias("valid_values"),
        )
    )
    return (
        catalog_rows.withColumn("column_key", F.lower("column_name"))
        .join(per_table, "table_name", "left")
        .join(per_column, ["table_name", "column_key"], "left")
        .drop("column_key")
    )
