"""Containment between the columns of many tables, from sketches and joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelore.operators import join_catalog
from tablelore.operators.join_catalog import (
    catalog_evidence, containment_bounds, key_pairs, key_sketches, widest_error,
)
from tablelore.sources.tables import row_counts_of

PAIR = "source_table string, source_col string, target_table string, target_col string"


def found(df):
    return {(r.source_table, r.source_col, r.target_table, r.target_col): r
            for r in df.collect()}


def test_small_tables_are_exact(frame):
    day = dt.date(2024, 1, 1)
    tables = {
        "a": frame("id int, `x.y` string, d date, v double, n int",
                   [(1, "", day, 0.5, None), (2, "p", day, 0.5, None), (2, None, None, 0.5, None)]),
        "b": frame("id bigint, s string, e date", [(1, "", day), (2, "q", day), (3, "r", None)]),
        "c": frame("v double", [(0.5,)]),
    }
    got = found(catalog_evidence(tables, least=0.5))
    assert {(k, r.low, r.holds) for k, r in got.items()} == {
        (("a", "id", "b", "id"), 1.0, True), (("a", "x.y", "b", "s"), 0.5, True),
        (("b", "s", "a", "x.y"), 1 / 3, False)}
    assert {r.settled_by for r in got.values()} == {"sketch"}
    none = frame(PAIR, [("a", "n", "b", "id"), ("b", "id", "a", "n")])
    got = found(catalog_evidence(tables, none))
    assert [(r.low, r.holds) for _, r in sorted(got.items())] == [(None, False), (0.0, False)]


@pytest.fixture(scope="module")
def wide(spark):
    ids = spark.range(120_000)
    return {
        "facts": ids.select((F.col("id") % 40_000).alias("k"), (F.col("id") * 3).alias("far"),
                            (F.col("id") % 40_000 + 4_000).alias("shifted")),
        "keys": spark.range(40_000).select(F.col("id").alias("k")),
    }


@pytest.mark.parametrize("least", [0.3, 0.9, 0.95, 1.0])
def test_sketches_never_decide_wrongly(wide, frame, least):
    true = {"k": 1.0, "shifted": 0.9, "far": 13_334 / 120_000}
    pairs = frame(PAIR, [("facts", c, "keys", "k") for c in true] + [("keys", "k", "facts", "k")])
    bounds = found(containment_bounds(key_sketches(wide), pairs))
    for c, share in true.items():
        row = bounds["facts", c, "keys", "k"]
        assert row.low <= share <= row.high and row.high - row.low < 4 * widest_error()
    got = found(catalog_evidence(wide, pairs, least=least))
    for c, share in true.items():
        assert got["facts", c, "keys", "k"].holds == (share >= least)
    by = {c: got["facts", c, "keys", "k"].settled_by for c in true}
    assert by["far"] == "sketch"
    if least != 0.95:  # near the bound either way is right
        assert by["shifted"] == ("join" if least == 0.9 else "sketch")


def test_near_keys_and_batches(wide, monkeypatch):
    monkeypatch.setattr(join_catalog, "BATCH", 1)
    sketches = key_sketches(wide, 10)
    assert {(r.table_name, r.column_name) for r in sketches.collect()} == {
        ("facts", "k"), ("facts", "far"), ("facts", "shifted"), ("keys", "k")}
    got = {k for k, r in found(catalog_evidence(wide, least=1.0)).items() if r.holds}
    assert got == {("facts", "k", "keys", "k")}
    assert ("keys", "k", "facts", "far") in found(key_pairs(sketches, unique=0.8))


def test_counts_of_many_files(spark, tmp_path):
    spark.range(60 * 61 // 2).select(
        F.expr("floor((sqrt(8 * id + 1) - 1) / 2)").cast("int").alias("t"), "id").repartition(
        3).write.partitionBy("t").parquet(f"{tmp_path}/all")
    paths = {f"t{i}": f"{tmp_path}/all/t={i}" for i in range(60)}
    spark.range(7).write.parquet(f"{tmp_path}/odd +é%20/x")
    spark.range(0).write.parquet(f"{tmp_path}/none")
    paths |= {"odd": f"{tmp_path}/odd +é%20", "none": f"{tmp_path}/none",
              "whole": f"{tmp_path}/all/", "again": f"{tmp_path}/all"}
    counts = row_counts_of(spark, paths)
    got = {r.table_name: r.row_count for r in counts.collect()}
    assert got == {f"t{i}": i + 1 for i in range(60)} | {
        "odd": 7, "none": 0, "whole": 1830, "again": 1830}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "ReadSchema: struct<>" in plan


def test_open_pairs_are_counted_together(spark, frame, monkeypatch):
    """Tiny sources in large targets stay open; their pairs share a few reads of each table."""
    large = spark.range(100_000).select("id", (F.col("id") * 2).alias("even"), F.concat(
        F.lit("t"), F.col("id")).alias("name"))
    small = [(i, i * 2, f"t{i}", f"u{i}" if i > 17 else f"t{i}") for i in range(20)]
    tables = {"large": large, "small": frame(
        "a int, `b.c` bigint, d string, e string", [*small, (None, 1, None, None), small[0]]),
        "wide": spark.range(5, 50_005).select(F.col("id").cast("int").alias("k"))}
    pairs = [("small", c, "large", t) for c in ("a", "b.c") for t in ("id", "even")]
    pairs += [("small", c, "large", "name") for c in "de"] + [("small", "a", "wide", "k")]
    true = dict(zip(pairs, (1.0, 0.5, 1.0, 20 / 21, 1.0, 0.9, 0.75), strict=True))
    evidence = []
    monkeypatch.setattr(join_catalog, "key_evidence", lambda *a: evidence.append(a))
    for columns, rows in ((63, 1_000_000), (3, 1_000_000), (63, 5), (63, 30)):
        monkeypatch.setattr(join_catalog, "MASK_COLUMNS", columns)
        monkeypatch.setattr(join_catalog._matched, "__defaults__", (rows,))
        got = found(catalog_evidence(tables, frame(PAIR, pairs)))
        assert {k: (r.low, r.high, r.holds, r.settled_by) for k, r in got.items()} == {
            k: (v, v, v >= 0.9, "join") for k, v in true.items()}
    assert not evidence  # no join for each pair
