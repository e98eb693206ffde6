"""Profiles that are kept up to date by reading only new files.

For every file of a table and every column a state is stored that can be merged with others:
counts, extremes, mean and spread, a distinct and a quantile sketch. A refresh lists the
table's files, reads those without a state and appends theirs; the profile is merged from
the states of the files that are there now. A file that was removed or written again drops
out by itself, because a file is known by its path, length and time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import share, sql_round
from ..functions.types import (
    is_floating, is_numeric, is_orderable, ref, sql_length, sql_name, sql_number,
    sql_struct,
)
from ..sources.rows import pick_columns
from .counts import slot_name, slots
from .profile import (
    _FULL, BATCH_COLUMNS, clamp_distinct, distinct_sketch, quantile_sketch,
)

_FILE = ("file", "file_length", "file_time")


def _state(df: DataFrame, pos: int, name: str, used: dict[str, str]) -> str:
    dt = df.schema[name].dataType
    c, number = sql_name(name), is_numeric(dt)
    x = sql_number(name, dt) if number else "cast(null as double)"
    fields = {
        "pos": str(pos), "column_name": "'" + name.replace("\\", "\\\\").replace(
            "'", "\\'") + "'",
        "column_type": f"'{dt.simpleString()}'", "total_rows": "count(1)",
        "non_null": f"count({c})", "numbers": f"count({x})", "mean": f"avg({x})",
        "squares": f"var_pop({x}) * count({x})",
        "distincts": distinct_sketch(name, dt), "quantiles": quantile_sketch(x),
        "min_length": "cast(null as bigint)" if number else
        f"cast(min({sql_length(name, dt)}) as bigint)",
        "max_length": "cast(null as bigint)" if number else
        f"cast(max({sql_length(name, dt)}) as bigint)",
    }
    for f in ("min", "max"):
        for slot, kind in used.items():
            own = is_orderable(dt) and slot == slot_name(dt)
            fields[f"{f}_{slot}"] = f"cast({f}({c}) as {kind})" if own else \
                f"cast(null as {kind})"
    return sql_struct(fields)


def file_states(df: DataFrame, columns: Sequence[str] | str | None = None) -> DataFrame:
    """One row of mergeable state per file and column of a frame that comes from files.

    Rows are aggregated in the tasks that read them; sketches are what is shuffled.
    """
    names = pick_columns(df, columns)
    used = slots(df, names)
    meta = df.metadataColumn("_metadata")
    own = df.select(
        meta["file_path"].alias("_file"), meta["file_size"].alias("_length"),
        meta["file_modification_time"].alias("_time"), *(ref(c) for c in names))
    parts = []
    for start in range(0, len(names), BATCH_COLUMNS):
        items = ", ".join(_state(df, start + i, c, used)
                          for i, c in enumerate(names[start:start + BATCH_COLUMNS]))
        parts.append(own.groupBy("_file", "_length", "_time").agg(
            F.expr(f"array({items})").alias("items")).select(
            F.col("_file").alias("file"), F.col("_length").alias("file_length"),
            F.col("_time").alias("file_time"), F.inline("items")))
    return reduce(DataFrame.unionByName, parts)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table, from the listing alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_size").alias("file_length"),
                        F.col("_metadata.file_modification_time").alias("file_time"))


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    return spark.read.option("mergeSchema", "true").parquet(folder)


def refresh_states(spark: SparkSession, path: str, folder: str,
                   columns: Sequence[str] | str | None = None) -> list[str]:
    """Append the states of files of the table at ``path`` that ``folder`` has none of.

    Returns the files that were read. Their names come to the driver, which lists a table's
    files anyway; an interrupted refresh is repeated by the next one.
    """
    files, known = _listed(spark, path), _stored(spark, folder)
    if known is not None:
        files = files.join(known.select(*_FILE).distinct(), list(_FILE), "left_anti")
    fresh = sorted(r["path"] for r in files.select("path").collect())
    if fresh:
        rows = spark.read.option("basePath", path).parquet(*fresh)
        file_states(rows, columns).write.mode("append").parquet(folder)
    return fresh


def current_states(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The states of the files that the table at ``path`` has now."""
    return spark.read.option("mergeSchema", "true").parquet(folder).join(
        _listed(spark, path).select(*_FILE), list(_FILE), "left_semi")


def profile_of_states(states: DataFrame) -> DataFrame:
    """The rows of ``profile``, merged from states; sketches are merged before a shuffle.

    A column that some files lack counts the rows of the files that have it.
    """
    kinds = {f.name.removeprefix("min_"): f.dataType for f in states.schema.fields
             if f.name.startswith("min_v_")}

    def extreme(f: str, kind: str) -> Column:
        found = [getattr(F, f)(f"{f}_{s}").cast(kind) for s, dt in kinds.items()
                 if is_numeric(dt) and (kind == "double" or not is_floating(dt))]
        return F.coalesce(F.lit(None).cast(kind), *found)

    differ = reduce(lambda a, b: a | b, [
        F.coalesce(F.min(f"min_{s}") < F.max(f"max_{s}"), F.lit(False)) for s in kinds],
        F.lit(False))
    weighted = F.sum(F.col("mean") * F.col("numbers"))
    merged = states.groupBy("column_name").agg(
        F.min("pos").alias("pos"), F.max("column_type").alias("column_type"),
        F.sum("total_rows").alias("total_rows"), F.sum("non_null").alias("non_null"),
        F.sum("numbers").alias("numbers"), (weighted / F.sum("numbers")).alias("mean"),
        F.sum("squares").alias("squares"),
        F.hll_sketch_estimate(F.hll_union_agg("distincts")).alias("estimate"),
        differ.alias("differ"),
        F.expr("if(sum(numbers) > 0, kll_sketch_get_quantile_double("
               "kll_merge_agg_double(quantiles), 0.5D), null)").alias("median_val"),
        extreme("min", "double").alias("min_val"), extreme("max", "double").alias("max_val"),
        extreme("min", "string").alias("min_text"), extreme("max", "string").alias("max_text"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
    # The files' means differ from the whole's; that is spread, too.
    between = states.join(merged.select("column_name", F.col("mean").alias("centre")),
                          "column_name").groupBy("column_name").agg(
        F.sum(F.col("numbers") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"))
    nulls = F.col("total_rows") - F.col("non_null")
    return merged.join(between, "column_name", "left").withColumns({
        "null_count": nulls, "null_pct": sql_round(share(nulls, F.col("total_rows")), 2),
        "distinct_count": clamp_distinct(F.greatest(
            "estimate", F.when(F.col("differ"), 2).otherwise(0).cast("bigint")),
            F.col("total_rows")),
        "mean_val": sql_round(F.col("mean"), 4),
        "stddev_val": sql_round(F.sqrt((F.col("squares") + F.col("between")) / F.nullif(
            F.col("numbers") - 1, F.lit(0))), 4),
    }).select("pos", *_FULL, F.col("total_rows").alias("row_count"))
