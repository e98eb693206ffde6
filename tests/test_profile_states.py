"""Profiles merged from states of files."""

import glob
import os

import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.operators.profile import profile
from tablelore.operators.profile_states import (
    current_states, file_states, profile_of_states, refresh_states,
)

SAME = ("total_rows", "null_count", "null_pct", "min_val", "max_val", "min_text", "max_text",
        "mean_val", "stddev_val", "min_length", "max_length", "column_type", "row_count")


def rows(spark, low, high, files=1):
    i = F.col("id")
    return spark.range(low, high, numPartitions=files).select(
        "id", (i * 1.5).alias("x"), (1_000_000_000 + i % 3).cast("double").alias("far"),
        F.when(i % 4 > 0, F.concat(F.lit("n"), i % 100)).alias("name"),
        (i % 2 == 0).alias("flag"), F.expr("date'2024-01-01' + cast(id % 400 as int)").alias("day"),
        F.lit(None).cast("int").alias("none"), (i / 7).cast("decimal(12, 3)").alias("price"),
        F.array("id").alias("list"), F.lit("x").alias("it's `odd`"))


def check(spark, table, states):
    own = by(profile_of_states(current_states(spark, table, states)), "column_name")
    whole = by(profile(spark.read.parquet(table)), "column_name")
    exact = by(profile(spark.read.parquet(table), exact=True), "column_name")
    assert set(own) == set(whole)
    for name, row in own.items():
        for field in SAME:
            assert row[field] == pytest.approx(whole[name][field], rel=1e-9, abs=1e-4) \
                if isinstance(row[field], float) else row[field] == whole[name][field], (
                    name, field)
        assert row["distinct_count"] == pytest.approx(exact[name]["distinct_count"], rel=0.03)
        if exact[name]["median_val"] is None:
            assert row["median_val"] is None
        else:
            assert row["median_val"] == pytest.approx(exact[name]["median_val"], rel=0.02)


def test_appended_files_alone_are_read(spark, tmp_path):
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    rows(spark, 0, 30_000, 3).write.parquet(table)
    assert len(refresh_states(spark, table, states)) == 3
    check(spark, table, states)
    rows(spark, 30_000, 31_000).write.mode("append").parquet(table)
    new = refresh_states(spark, table, states)
    assert len(new) == 1 and refresh_states(spark, table, states) == []
    assert spark.read.parquet(states).where("column_name = 'id'").agg(
        F.sum("total_rows")).first()[0] == 31_000
    check(spark, table, states)


def test_removed_and_rewritten_files(spark, tmp_path):
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    rows(spark, 0, 9_000, 3).write.parquet(table)
    refresh_states(spark, table, states)
    files = sorted(glob.glob(f"{table}/*.parquet"))
    os.remove(files[0])
    check(spark, table, states)
    rows(spark, 50_000, 52_000).coalesce(1).write.parquet(str(tmp_path / "other"))
    os.remove(os.path.join(table, f".{os.path.basename(files[1])}.crc"))
    os.replace(glob.glob(str(tmp_path / "other" / "*.parquet"))[0], files[1])
    assert [os.path.basename(f) for f in refresh_states(spark, table, states)] == [
        os.path.basename(files[1])]
    check(spark, table, states)


def test_new_columns_and_empty_files(spark, tmp_path):
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    rows(spark, 0, 10).select("id", "name").write.parquet(table)
    refresh_states(spark, table, states)
    rows(spark, 10, 30).select("id", "name", "day").write.mode("append").parquet(table)
    rows(spark, 0, 0).select("id", "name", "day").write.mode("append").parquet(table)
    refresh_states(spark, table, states)
    found = by(profile_of_states(current_states(spark, table, states)), "column_name")
    assert found["id"]["total_rows"] == 30 and found["day"]["total_rows"] == 20
    assert found["id"]["distinct_count"] == 30 and found["id"]["max_text"] == "29"


def test_states_are_merged_before_they_are_shuffled(spark, tmp_path):
    table, states = str(tmp_path / "t"), str(tmp_path / "s")
    rows(spark, 0, 100, 4).write.parquet(table)
    refresh_states(spark, table, states)
    plan = profile_of_states(current_states(spark, table, states))._jdf.queryExecution(
        ).executedPlan().toString()
    assert "partial_kll_merge_agg_double" in plan and "collect" not in plan
    scan = file_states(spark.read.parquet(table), ["id"])._jdf.queryExecution(
        ).executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in scan
