import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.operators.assertions import assert_sql, assertion_suite
from tablelore.operators.profile import clamp_distinct
from tablelore.operators.quality import duplicate_rows, invalid_values, quality
from tablelore.sources.sampling import plan_scan


def test_unique_columns(frame):
    users = frame("id int, name string, age int", [(1, "Alice", 30), (2, "Bob", 25)])
    rows = by(quality(users, exact=True), "column_name")
    assert rows["id"]["uniqueness_pct"] == rows["name"]["uniqueness_pct"] == 100.0
    assert rows["name"]["min_text"] == "Alice" and rows["age"]["max_val"] == 30.0
    assert rows["age"]["max_text"] == "30"
    assert duplicate_rows(users).collect()[0].duplicate_rows == 0


@pytest.mark.parametrize("exact", [True, False])
def test_null_signals(frame, exact):
    df = frame("id int, name string, notes string",
               [(i, None if i < 2 else f"n{i}", None) for i in range(10)])
    rows = by(quality(df, exact=exact), "column_name")
    assert rows["name"]["null_pct"] == 20.0 and rows["name"]["signals"] == []
    assert rows["notes"]["null_pct"] == 100.0
    assert rows["notes"]["signals"] == ["100.0% null", "0 distinct values (all null)"]
    assert {r["status"] for r in rows.values()} == {"ok"}


def test_low_uniqueness_is_a_signal_not_a_failure(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("active"))
    row = by(quality(df, exact=True), "column_name")["active"]
    assert row["signals"] == ["0.2% unique"] and row["status"] == "ok"


def test_distinct_never_exceeds_rows(spark):
    got = spark.range(1).select(clamp_distinct(F.lit(7), F.lit(5)).alias("v")).collect()[0].v
    assert got == 5


def test_empty_table_gives_zeros(frame):
    for row in quality(frame("a int, b string", []), exact=True).collect():
        assert (row.row_count, row.null_count, row.null_pct, row.distinct_count,
                row.uniqueness_pct) == (0, 0, 0.0, 0, 0.0)
        assert row.signals == [] and row.status == "ok" and row.min_text is None


def test_duplicates(frame):
    dupes = frame("name string, value int", [("a", 1)] * 3 + [("b", 2)])
    for hash_first in (False, True):
        row = duplicate_rows(dupes, hash_first=hash_first).collect()[0]
        assert (row.duplicate_rows, row.duplicated_groups) == (2, 1)


def test_duplicates_tell_null_positions_apart(frame):
    # Hashing skips nulls, so these two rows share a hash and must still differ.
    df = frame("a string, b string, x double",
               [("v", None, 0.0), (None, "v", 0.0), ("w", "w", -0.0), ("w", "w", 0.0)])
    for hash_first in (False, True):
        assert duplicate_rows(df, hash_first=hash_first).collect()[0].duplicate_rows == 1


def test_duplicates_on_chosen_and_nested_columns(frame):
    df = frame("id int, tags array<string>", [(1, ["a"]), (2, ["a"]), (3, ["b"])])
    assert duplicate_rows(df, ["tags"]).collect()[0].duplicate_rows == 1
    assert duplicate_rows(df).collect()[0].duplicate_rows == 0


def test_allowed_values(frame):
    df = frame("status string, n int",
               [("open", 1), ("closed", 2), ("odd", 3), (None, 4), ("odd", 9)])
    rows = by(quality(df, exact=True, allowed={"STATUS": ["open", "closed"], "n": [1, 2, 3, 4]}),
              "column_name")
    assert rows["status"]["invalid_count"] == 2 and rows["status"]["status"] == "fail"
    assert rows["status"]["issues"] == ["2 value(s) not in valid_values (2 allowed)"]
    assert rows["n"]["invalid_count"] == 1
    # more values than a scan carries are joined
    many = {"Status": ["open", "closed", *map(str, range(2000))], "n": range(2000)}
    rows = by(quality(df, exact=True, allowed=many), "column_name")
    assert rows["status"]["invalid_count"] == 2 and rows["n"]["invalid_count"] == 0
    assert rows["status"]["issues"] == ["2 value(s) not in valid_values (2002 allowed)"]


def test_allowed_values_from_a_table(frame):
    df = frame("status string, n int",
               [("open", 1), ("closed", 2), ("odd", 3), (None, 4), ("odd", 9)])
    allowed = frame("column_name string, value string",
                    [("status", "open"), ("status", "closed"), ("n", "1"), ("n", "2"),
                     ("n", "3"), ("n", "4"), ("n", "9"), ("other", "x")])
    rows = by(invalid_values(df, allowed), "column_name")
    assert set(rows) == {"status", "n"}
    assert (rows["status"]["invalid_count"], rows["status"]["status"]) == (2, "fail")
    assert (rows["n"]["invalid_count"], rows["n"]["issue"]) == (0, None)


def test_sample_reports_its_own_size(spark):
    scan = plan_scan(spark.range(10_000).toDF("id"), sample=100)
    assert abs(quality(scan).collect()[0].row_count - 100) < 60


# --- assertions -------------------------------------------------------------------

@pytest.mark.parametrize("operator,expected,passed", [
    ("eq", 3, True), ("eq", 4, False), ("gt", 2, True), ("gt", 3, False), ("lt", 4, True),
    ("gte", 3, True), ("lte", 2, False),
])
def test_assertions(spark, operator, expected, passed):
    row = assert_sql(spark, "select count(*) from range(3)", operator, expected, "n").collect()[0]
    assert (row.name, row.actual, row.passed) == ("n", 3.0, passed)


def test_null_and_text_do_not_pass(spark):
    rows = assertion_suite(spark, [
        {"sql": "select cast(null as int)", "operator": "eq", "expected": 0},
        {"sql": "select 'abc'", "operator": "eq", "expected": 0},
        {"sql": "select '5', 'ignored'", "operator": "eq", "expected": 5},
    ]).collect()
    assert [r.passed for r in rows] == [False, False, True]


def test_nothing_to_judge_is_an_error(spark):
    with pytest.raises(Exception, match="no rows"):
        assert_sql(spark, "select id from range(0)", "eq", 0).collect()
    with pytest.raises(ValueError, match="invalid operator"):
        assert_sql(spark, "select 1", "ne", 0)


@pytest.mark.parametrize("distinct,rows,expected", [
    (9, 6000, "0.1"), (1, 400, "0.2"), (3, 400, "0.8"), (3, 1000, "0.3"), (7, 1000, "0.7"),
    (1, 10**6, "0.0"), (35, 10_000, "0.3"), (45, 10_000, "0.5"), (99, 10_000, "1.0"),
])
def test_signals_round_like_the_exact_number(spark, distinct, rows, expected):
    from tablelore.operators.quality import signals

    assert f"{100.0 * distinct / rows:.1f}" == expected
    got = spark.range(1).select(signals(F.lit(0.0), F.lit(distinct), F.lit(rows)).alias("s")
                                ).collect()[0].s
    assert got == [f"{expected}% unique"]
