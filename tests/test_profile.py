import random
import statistics

import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.functions import fixed, names
from tablelore.operators.columns import (
    category_of, column_categories, column_roles, columns_by_category,
)
from tablelore.operators.profile import approx_top_values, profile
from tablelore.operators.quality import quality
from tablelore.sources.sampling import (
    Scan, block_sample, modulus_sample, percent_sample, plan_scan, sample_rows,
)
from tablelore.sources.tables import column_catalog

ZOO = """id INT, bool_val BOOLEAN, date_val DATE, datetime_val TIMESTAMP_NTZ,
 time_val STRING, int_val INT, bigint_val BIGINT, hugeint_val DECIMAL(38,0),
 float_val FLOAT, double_val DOUBLE, decimal_val DECIMAL(18,4), text_val STRING,
 long_text_val STRING, blob_val BINARY, json_val STRING, list_int_val ARRAY<INT>,
 list_text_val ARRAY<STRING>, struct_val STRUCT<name: STRING, value: INT, active: BOOLEAN>,
 map_val MAP<STRING, INT>, nested_list_val ARRAY<ARRAY<INT>>, uuid_val STRING,
 nullable_int INT, nullable_text STRING, empty_str_val STRING, negative_val DOUBLE,
 zero_val DOUBLE"""


@pytest.fixture
def zoo(spark):
    return spark.range(100).select(F.expr("cast(id as int)").alias("id"), *[F.expr(e) for e in (
        "id % 2 = 0 as bool_val", "date_add(date'2024-01-01', cast(id as int)) as date_val",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as datetime_val",
        "'12:00:00' as time_val", "cast(id as int) as int_val",
        "9007199254740993 + id as bigint_val",
        "cast('12345678901234567890123456789' as decimal(38,0)) + id as hugeint_val",
        "cast(id / 4 as float) as float_val", "id / 4 as double_val",
        "cast(id / 8 as decimal(18,4)) as decimal_val", "concat('t', id % 7) as text_val",
        "repeat('x', cast(id as int)) as long_text_val",
        "cast(concat('b', id % 3) as binary) as blob_val", "to_json(named_struct('k', id % 5)) "
        "as json_val", "array(cast(id % 3 as int), 1) as list_int_val",
        "array(concat('a', id % 2)) as list_text_val",
        "named_struct('name', concat('n', id % 4), 'value', cast(id % 2 as int), 'active', true)"
        " as struct_val", "map('k', cast(id % 6 as int)) as map_val",
        "array(array(cast(id % 2 as int))) as nested_list_val", "uuid() as uuid_val",
        "if(id % 4 = 0, null, cast(id as int)) as nullable_int",
        "if(id % 5 = 0, null, 'v') as nullable_text", "'' as empty_str_val",
        "-cast(id as double) as negative_val", "0.0d as zero_val")])


def test_zoo_has_all_types(spark, zoo):
    assert zoo.columns == spark.createDataFrame([], ZOO).columns


@pytest.mark.parametrize("exact", [True, False])
def test_profile_of_every_type(zoo, exact):
    rows = by(profile(zoo, exact=exact), "column_name")
    assert len(rows) == 26
    assert rows["nullable_int"]["null_count"] == 25
    assert rows["nullable_text"]["null_pct"] == 20.0
    assert rows["map_val"]["distinct_count"] == 6
    assert rows["struct_val"]["distinct_count"] == 4
    assert rows["list_int_val"]["distinct_count"] == 3
    assert rows["blob_val"]["distinct_count"] == 3 and rows["blob_val"]["min_length"] == 2
    assert rows["long_text_val"]["min_length"] == 0
    assert rows["long_text_val"]["max_length"] == 99
    assert rows["date_val"]["min_length"] == 10 and rows["datetime_val"]["max_length"] == 19
    assert rows["negative_val"]["min_val"] == -99.0
    assert rows["zero_val"]["distinct_count"] == 1 and rows["zero_val"]["stddev_val"] == 0.0
    # Large integers keep all digits in the text form.
    assert rows["bigint_val"]["max_text"] == "9007199254741092"
    assert rows["hugeint_val"]["min_text"] == "12345678901234567890123456789"
    assert rows["decimal_val"]["min_text"] == "0.0000"
    assert rows["text_val"]["min_val"] is None and rows["text_val"]["mean_val"] is None
    if exact:
        assert rows["double_val"]["median_val"] == 49.5 / 4
        assert rows["uuid_val"]["distinct_count"] == 100


def test_rare_types(spark):
    df = spark.sql("""select parse_json('{"a":1}') as v, interval '1' day as i,
        interval '2' month as m, cast(1 as tinyint) as b, cast('x' as char(3)) as c,
        make_interval(1) as k from range(3)""")
    for rows in (profile(df, exact=True), profile(df, top=2), profile(df, quick=True)):
        found = by(rows, "column_name")
        assert {r["distinct_count"] for r in found.values()} == {1} and len(found) == 6
    assert by(profile(df, top=2), "column_name")["i"]["top_values"] == ["INTERVAL '1' DAY"]
    assert by(quality(df), "column_name")["m"]["min_text"] == "INTERVAL '2' MONTH"


def test_quick_has_counts_only(zoo):
    quick = profile(zoo, quick=True)
    assert "mean_val" not in quick.columns and quick.count() == 26


def test_empty_table(frame):
    rows = by(profile(frame("a int, b string", []), exact=True), "column_name")
    assert rows["a"]["total_rows"] == 0 and rows["a"]["null_pct"] is None
    assert rows["a"]["distinct_count"] == 0 and rows["b"]["max_length"] is None
    rows = by(profile(frame("a int, b string", [])), "column_name")
    assert rows["a"]["median_val"] is None


def test_columns_in_any_case_and_unknown(frame):
    df = frame("id int, Name string", [(1, "a")])
    assert [r.column_name for r in profile(df, "NAME, nothing").collect()] == ["Name"]
    with pytest.raises(ValueError, match="available columns: id, Name"):
        profile(df, ["missing"])


def test_dotted_column_names(frame):
    df = frame("`a.b` int, `c``d` string", [(1, "x"), (2, "x")])
    rows = by(profile(df, exact=True), "column_name")
    assert rows["a.b"]["distinct_count"] == 2 and rows["c`d"]["distinct_count"] == 1


@pytest.mark.parametrize("seed", range(6))
def test_exact_median_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 1000, 5001])
    hot = rng.choice([0.0, 0.34, 0.8])
    values = [7.5 if rng.random() < hot else rng.gauss(0, 10 ** rng.randint(0, 6))
              for _ in range(n)]
    whole = [rng.randint(-5, 5) if rng.random() < 0.9 else None for _ in range(n)]
    df = spark.createDataFrame(list(zip(values, whole)), "x double, k int")
    rows = by(profile(df, exact=True), "column_name")
    assert rows["x"]["median_val"] == pytest.approx(statistics.median(values), rel=1e-12)
    known = [v for v in whole if v is not None]
    expected = statistics.median(known) if known else None
    assert rows["k"]["median_val"] == expected
    assert rows["x"]["distinct_count"] == len(set(values))


def test_nan_and_infinity_have_no_moments(frame):
    df = frame("x double", [(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)])
    row = profile(df, exact=True).collect()[0]
    assert row.mean_val == 2.0 and row.median_val == 2.0 and row.null_count == 1


def test_approximate_within_bounds(spark):
    df = spark.range(50_000).select(F.col("id"), (F.col("id") % 1000).alias("k"))
    rows = by(profile(df), "column_name")
    assert abs(rows["id"]["distinct_count"] - 50_000) < 50_000 * 0.15
    assert rows["id"]["distinct_count"] <= 50_000
    assert abs(rows["id"]["median_val"] - 25_000) < 500
    assert abs(rows["k"]["distinct_count"] - 1000) < 150


def test_wide_tables_give_the_same_in_batches(spark):
    df = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(60)])
    whole = profile(df, exact=True, batch_columns=60).collect()
    assert sorted(whole) == sorted(profile(df, exact=True).collect())
    assert [r.column_name for r in sorted(whole, key=lambda r: r.pos)] == df.columns


def test_top_values_ride_along(frame):
    df = frame("s string, n int", [("a", 1), ("a", 2), ("b", 3), (None, 4)])
    rows = by(profile(df, top=5), "column_name")
    assert rows["s"]["top_values"] == ["a", "b"] and rows["n"]["top_values"] is None
    with pytest.raises(ValueError):
        profile(df, exact=True, top=5)


@pytest.fixture(scope="module")
def tails(spark):
    """A long tail, a key, a column without values and one with three values."""
    return spark.range(0, 300_000, numPartitions=4).select(
        F.when(F.col("id") % 5 < 3, F.concat(F.lit("v"), F.col("id") % 5)).otherwise(
            F.concat(F.lit("t"), F.col("id"))).alias("tail"),
        F.concat(F.lit("k"), F.col("id")).alias("key"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("three"))


def test_only_proved_values_are_all(tails):
    rows = by(profile(tails, top=4), "column_name")
    assert {n: r["all_values"] for n, r in rows.items()} == {
        "tail": False, "key": False, "none": True, "three": True}
    assert {n: len(r["top_values"]) for n, r in rows.items()} == {
        "tail": 4, "key": 4, "none": 0, "three": 3}
    assert {"v0", "v1", "v2"} < set(rows["tail"]["top_values"])
    # asked for as many as there are, and for fewer
    assert by(profile(tails, ["three"], top=3), "column_name")["three"]["all_values"]
    assert not by(profile(tails, ["three"], top=2), "column_name")["three"]["all_values"]


def test_every_column_has_top_values(tails):
    rows = approx_top_values(tails, top=5).collect()
    assert {r.column_name for r in rows} == set(tails.columns)
    assert [r.value for r in rows if r.column_name == "none"] == [None]
    for r in rows:
        assert r.total_rows == 300_000
        if r.column_name == "key":
            assert r["count"] == 1 and r.max_error > 0 and not r.all_values
        if r.value in ("v0", "v1", "v2"):
            assert abs(r["count"] - 60_000) <= r.max_error
        if r.column_name == "three":
            assert r.max_error == 0 and r.all_values and r.null_count == 42_858


def test_no_false_list_in_many_columns(spark):
    """Columns of every size around the number asked for."""
    sizes = {f"c{n}_{skew}": (n, skew) for n in range(1, 21) for skew in (0, 1)}
    df = spark.range(0, 40_000, numPartitions=3).select(*[
        F.concat(F.lit("x"), F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(
            F.col("id") % n) if skew else F.col("id") % n).alias(c)
        for c, (n, skew) in sizes.items()])
    rows = by(profile(df, top=10), "column_name")
    real = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first().asDict()
    assert {c: r["all_values"] for c, r in rows.items()} == {
        c: n <= 10 for c, n in real.items()}


def test_approx_top_values_skip_nulls(frame):
    df = frame("s string", [("a",), ("a",), (None,), (None,), (None,), ("b",)])
    rows = [(r.value, r["count"], r.null_count) for r in approx_top_values(df, top=2).collect()]
    assert rows == [("a", 2, 3), ("b", 1, 3)]


# --- sampling ---------------------------------------------------------------------

def test_everything_is_read_unless_a_sample_is_asked_for(spark):
    big = spark.range(1_100_000).select("id", (F.col("id") * 0.5).alias("val"))
    assert not plan_scan(big).sampled
    row = profile(plan_scan(big), "id", exact=True, quick=True).collect()[0]
    assert row.row_count == row.total_rows == row.distinct_count == 1_100_000
    assert not plan_scan(big, sample=500, no_sample=True).sampled


def test_sample_is_drawn_once_and_spread(spark):
    big = spark.range(0, 200_000, numPartitions=8).select("id", (F.col("id") * 0.5).alias("val"))
    scan = plan_scan(big, sample=20_000)
    assert scan.sampled and scan.sample_size == 20_000 and scan.row_count == 200_000
    drawn = scan.data.count()
    assert abs(drawn - 20_000) < 1_000
    assert scan.data.inputFiles() and len(scan.data.inputFiles()) == 8
    row = profile(scan).collect()[0]
    assert row.row_count == 200_000 and row.total_rows == drawn and row.sampled


def test_explicit_sample_larger_than_table_reads_all(spark):
    scan = plan_scan(spark.range(10), sample=50)
    assert not scan.sampled and scan.data.count() == 10


def test_samples_of_huge_tables_are_thinned_alike(spark):
    df = spark.range(100_000)
    # A table said to be huge keeps its rate.
    assert sample_rows(df, 1, 1_000_000_000_000, seed=3).count() < 5
    assert 4_000 < percent_sample(df, 5.0, seed=1).count() < 6_000


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """One large file and many small ones, in the order of the ids."""
    path = str(tmp_path_factory.mktemp("uneven") / "t")
    spark.range(0, 400_000, numPartitions=1).write.parquet(path)
    spark.range(400_000, 440_000, numPartitions=80).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("seed", range(5))
def test_samples_of_files_of_any_size(uneven, seed):
    for drawn, rows_together in (
            (sample_rows(uneven, 44_000, 440_000, seed), 1),
            (percent_sample(uneven, 10.0, seed), 1),
            (block_sample(uneven, 10.0, seed, block_rows=100), 100)):
        row = drawn.agg(F.count("id").alias("n"), F.avg("id").alias("mean")).first()
        assert abs(row.n - 44_000) < 6 * (44_000 * rows_together) ** 0.5
        error = 440_000 / 12**0.5 / (44_000 / rows_together) ** 0.5
        assert abs(row.mean - 220_000) < 5 * error


@pytest.mark.parametrize("n", [1, 17, 999, 44_000, 439_999, 440_000])
def test_sample_of_exactly_n_rows(uneven, n):
    assert sample_rows(uneven, n, 440_000, seed=n).count() == min(n, 440_000)


def test_exact_sample_is_repeatable_and_spread(uneven, spark):
    def ids(seed):
        return sorted(r.id for r in sample_rows(uneven, 5_000, 440_000, seed).collect())

    first = ids(1)
    parts = sample_rows(uneven, 5_000, 440_000, 1).groupBy(F.spark_partition_id()).count()
    assert len(set(first)) == 5_000 and parts.count() > 1 and ids(2) != first
    plan = sample_rows(uneven, 5_000, 440_000, 1)._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Sort" not in plan.toString()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        assert ids(1) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_exact_sample_of_repeated_rows(spark):
    same = spark.range(1_000).select(F.lit("x").alias("a"))
    assert sample_rows(same, 123, 1_000).count() == 123
    mixed = same.unionAll(spark.range(1_000).select(F.col("id").cast("string")))
    assert sample_rows(mixed, 1_500, 2_000).count() == 1_500
    assert sample_rows(mixed, 3_000, 4_000).count() == 2_000  # a table that has shrunk


def test_block_sample_outlives_a_copy(spark, tmp_path):
    rows = spark.range(0, 20_000, numPartitions=3)
    drawn = []
    for name in ("first", "second"):
        rows.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        drawn.append(sorted(r.id for r in block_sample(table, 30.0, block_rows=10).collect()))
    assert drawn[0] == drawn[1] and 4_000 < len(drawn[0]) < 8_000


def test_block_sample_keeps_neighbours(uneven, spark):
    rows = block_sample(uneven, 10.0, 3, block_rows=100).where("id < 400000").groupBy(
        (F.col("id") / 100).cast("int")).count().collect()
    assert len(rows) > 300 and {r["count"] for r in rows} == {100}
    # frames without files are thinned row by row
    assert 3_000 < block_sample(spark.range(40_000), 10.0).count() < 5_000


def test_modulus_sample(spark):
    df = spark.range(1000)
    assert [r.id for r in modulus_sample(df, F.col("id"), 100, 1000).collect()
            ] == list(range(0, 1000, 10))
    # all matches, not the first ones
    assert [r.id for r in modulus_sample(df, F.col("id"), 3, 1000).collect()] == [0, 333, 666, 999]
    with pytest.raises(ValueError):
        modulus_sample(df, F.col("id"), 0, 1000)


def test_sample_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        sample_rows(spark.range(5), 0, 5)


def test_scan_is_transparent(spark):
    df = spark.range(3)
    assert profile(Scan(df)).collect() == profile(df).collect()


# --- roles and categories ---------------------------------------------------------

CATEGORIES = [
    ("flag", "string", 1, 0.0, "constant"),
    ("notes", "string", 5, 95.0, "sparse"),
    ("email", "string", 98, 0.0, "high_cardinality"),
    ("created_at", "timestamp", 60, 0.0, "time"),
    ("amount", "double", 60, 0.0, "measure"),
    ("status", "string", 5, 0.0, "low_cardinality"),
    ("city", "string", 60, 0.0, "other"),
    ("mostly_null_constant", "string", 1, 99.0, "constant"),
    ("customer_id", "bigint", 60, 0.0, "other"),
    ("o_orderkey", "bigint", 60, 0.0, "measure"),
    ("o_orderkey", "bigint", 100, 0.0, "high_cardinality"),
]


@pytest.mark.parametrize("name,kind,distinct,null_pct,expected", CATEGORIES)
def test_category_rules(frame, name, kind, distinct, null_pct, expected):
    stats = frame("column_name string, column_type string, distinct_count bigint, "
                  "null_pct double, total_rows bigint", [(name, kind, distinct, null_pct, 100)])
    assert column_categories(stats).collect()[0].category == expected


def test_empty_categories_are_absent(frame):
    stats = frame("pos int, column_name string, column_type string, distinct_count bigint, "
                  "null_pct double, total_rows bigint",
                  [(0, "b", "string", 1, 0.0, 9), (1, "a", "string", 1, 0.0, 9)])
    rows = columns_by_category(column_categories(stats)).collect()
    assert [(r.category, r.columns) for r in rows] == [("constant", ["b", "a"])]


def test_schema_rule_equals_catalog_rule(zoo):
    wanted = {f.name: names.role(f.name, f.dataType) for f in zoo.schema.fields}
    got = {r.column_name: r.role for r in column_roles(column_catalog({"zoo": zoo})).collect()}
    assert got == wanted
    assert wanted["date_val"] == "time_dimension" and wanted["int_val"] == "measure"


def test_category_limits_are_strict(spark):
    row = spark.range(1).select(
        category_of(F.lit(50), F.lit(0.0), F.lit(1000), F.lit("dimension")).alias("a"),
        category_of(F.lit(49), F.lit(0.0), F.lit(1000), F.lit("dimension")).alias("b"),
        category_of(F.lit(95), F.lit(90.0), F.lit(100), F.lit("dimension")).alias("c"),
    ).collect()[0]
    assert (row.a, row.b, row.c) == ("other", "low_cardinality", "other")
    assert fixed.LOW_CARDINALITY_LIMIT == 50
