import pytest
from conftest import by
from pyspark.sql import functions as F

from tablelore.operators.counts import text_counts
from tablelore.operators.pivot import model_metrics, pivot
from tablelore.operators.values import (
    categories, distinct_values, distribution, histogram, sample_values, settled_counts,
    top_values, values_summary,
)


def test_truncated_listing_knows_the_real_count(spark):
    items = spark.range(50).select("id", F.concat(F.lit("label "), "id").alias("label"))
    rows = distinct_values(items, "label", 10).collect()
    assert len(rows) == 10
    assert {(r.distinct_count, r.truncated) for r in rows} == {(50, True)}


def test_nulls_are_counted_not_listed(frame):
    df = frame("id int, status string", [(1, "active"), (2, None), (3, "inactive"), (4, None)])
    rows = distinct_values(df, "status").collect()
    assert [r.value for r in rows] == ["active", "inactive"]
    assert {(r.total_rows, r.null_count, r.distinct_count) for r in rows} == {(4, 2, 2)}


@pytest.mark.parametrize("rows,total,nulls,distinct", [
    ([(1, "active"), (2, None), (3, "inactive")], 3, 1, 2),
    ([(1, None), (2, None), (3, None)], 3, 3, 0),
    ([], 0, 0, 0),
])
def test_summary(frame, rows, total, nulls, distinct):
    df = frame("id int, status string", rows)
    got = values_summary(df, "status").collect()[0]
    assert (got.total_rows, got.null_count, got.distinct_count, got.truncated) == (
        total, nulls, distinct, False)
    assert distinct_values(df, "status").count() == distinct


def test_numbers_sort_as_text_by_value(frame):
    df = frame("n int", [(10,), (9,), (9,), (100,)])
    assert [r.value for r in distinct_values(df, "n").collect()] == [10, 100, 9]
    assert [r.value for r in distinct_values(df, "n", sort="frequency").collect()
            ] == [9, 10, 100]
    with pytest.raises(ValueError):
        distinct_values(df, "n", sort="size")


def test_exactly_max_values_is_not_truncated(frame):
    df = frame("s string", [("a",), ("b",), (None,)])
    assert {r.truncated for r in distinct_values(df, "s", 2).collect()} == {False}


def test_top_values_per_column(frame):
    df = frame("s string, n int", [("a", 1), ("b", 2), ("b", None), (None, None)])
    rows = [(r.column_name, r.rank, r.value, r["count"], r.non_null_rows, r.total_rows,
             r.null_count) for r in top_values(df, top=1).orderBy("pos").collect()]
    assert rows == [("s", 1, "b", 2, 3, 4, 1), ("n", 1, "1", 1, 2, 4, 2)]


def test_large_top_uses_two_rounds_with_the_same_result(spark):
    df = spark.range(5000).select((F.col("id") % 3000).alias("k"))
    small = {r.value: r["count"] for r in top_values(df, top=1000).collect()}
    large = {r.value: r["count"] for r in top_values(df, top=2500).collect()}
    assert len(small) == 1000 and len(large) == 2500
    assert all(large[v] == n for v, n in small.items())
    assert sum(n == 2 for n in large.values()) == 2000


def test_sample_values(frame):
    df = frame("s string, n int", [(f"v{i % 30:02}", None) for i in range(90)])
    rows = sample_values(df).collect()
    assert [r.value for r in rows] == [f"v{i:02}" for i in range(25)]


# --- distribution -----------------------------------------------------------------

@pytest.fixture
def sales(frame):
    rows = [(i, float(i), ("electronics", "books", "electronics", "toys")[i % 4], None)
            for i in range(100)] + [(100, None, None, None), (101, None, None, None)]
    return frame("id int, amount double, category string, notes string", rows)


def test_numeric_distribution(sales):
    rows = distribution(sales, "amount", 5).collect()
    assert len(rows) <= 5 and sum(r["count"] for r in rows) == 100
    assert {(r.total_rows, r.null_count) for r in rows} == {(102, 2)}
    assert rows[0].bucket_min == 0.0 and rows[-1].bucket_max == 99.0
    assert [r["count"] for r in rows] == [20] * 5


def test_categorical_distribution(sales):
    rows = distribution(sales, "CATEGORY", top=2).collect()
    assert rows[0].value == "electronics" and rows[0]["count"] == 50
    assert rows[0].listed_pct == round(100 * 50 / 75, 1)
    assert rows[0].non_null_rows == 100 and rows[0].null_count == 2


def test_all_null_and_unknown_columns(sales):
    assert distribution(sales, "notes").collect() == []
    assert histogram(sales.where("amount is null"), "amount").collect() == []
    with pytest.raises(ValueError, match="available columns"):
        distribution(sales, "nothing")


def test_constant_column_is_one_bucket(frame):
    mono = frame("id int, val double, label string", [(i, 42.0, "x") for i in range(10)])
    rows = distribution(mono, "val").collect()
    assert [(r.bucket, r["count"], r.bucket_min) for r in rows] == [(0, 10, 42.0)]


def test_empty_table(frame):
    assert distribution(frame("v double", []), "v").collect() == []
    assert categories(frame("s string", []), "s").collect() == []


def test_not_numbers_have_no_bucket(frame):
    df = frame("x double", [(1.0,), (2.0,), (float("nan"),), (float("-inf"),), (None,)])
    rows = histogram(df, "x", 2).collect()
    assert [r["count"] for r in rows] == [1, 1] and rows[0].null_count == 3


# --- pivot and metrics ------------------------------------------------------------

def test_pivot(frame):
    df = frame("id int, region string, status string, amount double", [
        (1, "east", "open", 10.0), (2, "east", "done", 20.0), (3, "east", "open", 30.0),
        (4, "west", "open", 1.0), (5, "west", "done", 2.0), (6, "west", "done", 3.0)])
    assert {r.region: r.count_id for r in pivot(df, ["region"], ["id"], "count").collect()
            } == {"east": 3, "west": 3}
    rows = pivot(df, ["region", "status"], ["amount"], "SUM", "amount > 1",
                 ["sum_amount"], 2).collect()
    assert [(r.region, r.status, r.sum_amount) for r in rows] == [
        ("west", "done", 5.0), ("east", "done", 20.0)]


def test_count_star_keeps_null_groups(frame):
    df = frame("id int, region string, status string, amount double",
               [(1, "east", "a", 1.0), (2, None, "b", None), (3, "east", "c", None),
                (4, None, "d", 2.0)])
    rows = {r.region: (r.count_star, r.count_amount)
            for r in pivot(df, ["region"], ["*", "amount"], "count").collect()}
    assert rows == {"east": (2, 1), None: (2, 1)}


@pytest.mark.parametrize("agg,values", [("median", ["a"]), ("sum", ["*"])])
def test_pivot_refuses(frame, agg, values):
    with pytest.raises(ValueError):
        pivot(frame("a int", [(1,)]), ["a"], values, agg)


def test_metrics_by_name(frame):
    df = frame("region string, revenue double, click_rate double, user_id int",
               [("e", 1.0, 0.2, 9), ("e", 2.0, 0.4, 9), ("w", 5.0, 0.5, 9)])
    rows = by(model_metrics(df, "region"), "region")
    assert set(rows["e"]) == {"region", "row_count", "sum_revenue", "avg_click_rate"}
    assert rows["e"]["sum_revenue"] == 3.0
    assert rows["e"]["avg_click_rate"] == pytest.approx(0.3)


# --- top values in two rounds -------------------------------------------------------

def shuffled_rows(spark, run):
    """Rows that all stages of a run write for others."""
    context = spark._jsparkSession.sparkContext()
    context.listenerBus().waitUntilEmpty()

    def total():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = context.statusStore().stageList(
            spark._jvm.java.util.ArrayList(), False, False, none, spark._jvm.java.util.ArrayList())
        found = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)
        return sum(x.shuffleWriteRecords() for x in found)

    before = total()
    run()
    context.listenerBus().waitUntilEmpty()
    return total() - before


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A hot value, a long tail behind frequent values, a key, few values, many types."""
    path = str(tmp_path_factory.mktemp("skewed") / "t")
    i = F.col("id")
    spark.range(0, 200_000, numPartitions=4).select(
        F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), i % 40)).alias("hot"),
        F.when(i % 2 == 0, (F.pmod(F.xxhash64("id"), F.lit(20)))).otherwise(i).alias("tail"),
        i.alias("key"), (i % 5 / 2).alias("few"),
        F.when(i % 7 > 0, i % 11 == 0).alias("flag"),
        F.expr("date'2024-01-01' + cast(id % 30 as int)").alias("day"),
        (i % 50).cast("decimal(9, 2)").alias("price"), F.array(i % 4).alias("nested"),
        F.lit(None).cast("string").alias("none"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def grouped(df, column, top):
    counted = df.where(F.col(column).isNotNull()).groupBy(
        (F.to_json(column) if column == "nested" else F.col(column)).alias("v")).count()
    return [(r.v if isinstance(r.v, str) else r.text, r["count"]) for r in counted.withColumn(
        "text", F.col("v").cast("string")).orderBy(F.desc("count"), "text").limit(top).collect()]


@pytest.mark.parametrize("top", [1, 3, 10])
def test_top_values_are_those_of_grouping(skewed, top):
    rows = top_values(skewed, top=top).orderBy("pos", "rank").collect()
    for c in skewed.columns:
        assert [(r.value, r["count"]) for r in rows if r.column_name == c] == grouped(
            skewed, c, top), c


def test_columns_are_settled_only_by_proof(skewed):
    _, settled = settled_counts(skewed, skewed.columns, 10)
    assert {skewed.columns[r.pos] for r in settled.collect()} == {
        "hot", "tail", "few", "flag", "day", "price", "none"}
    # twenty frequent values; the twenty-first is one of a hundred thousand
    _, settled = settled_counts(skewed, ["tail"], 21)
    assert settled.collect() == []
    # and all are right in the end
    assert len(top_values(skewed, ["tail"], 21).collect()) == 21


def test_skewed_columns_are_not_shuffled(spark, skewed):
    few = shuffled_rows(spark, lambda: top_values(skewed, ["tail"], 5).collect())
    many = shuffled_rows(spark, lambda: skewed.groupBy("tail").count().collect())
    assert many > 90_000 and few < 4 * 2 * (4_096 + 210) + 1_000


def test_smallest_values_are_not_shuffled(spark, skewed):
    few = shuffled_rows(spark, lambda: sample_values(skewed, ["key"], 25).collect())
    assert few < 4 * 2 * (1_024 + 100)
    rows = [r.value for r in sample_values(skewed, ["key"], 25).orderBy("rank").collect()]
    assert rows == sorted(map(str, range(200_000)))[:25]


@pytest.mark.parametrize("limit", [1, 2, 40, 5_000])
def test_smallest_values_of_any_number(skewed, limit):
    rows = sample_values(skewed, ["hot", "key", "none", "day"], limit).collect()
    for c in ("hot", "key", "none", "day"):
        want = sorted(str(r[0]) for r in skewed.select(c).distinct().dropna().collect())
        assert sorted(r.value for r in rows if r.column_name == c) == want[:limit]


def test_two_rounds_of_nothing(frame):
    df = frame("a string, b bigint", [])
    assert top_values(df).collect() == [] and sample_values(df).collect() == []
    df = frame("a string, b bigint", [(None, None), (None, None)])
    assert top_values(df).collect() == [] and sample_values(df).collect() == []


def test_only_asked_values_are_counted(frame):
    """Others are left out before the grouping; null asks for nothing."""
    df = frame("a int, b string, c double", [
        (1, "x", 0.5), (1, "1", None), (2, None, 0.5), (None, "x", 1.5), (1, "y", 0.5)])
    only = frame("column_name string, value string, rank int", [
        ("a", "1", 1), ("a", "7", 2), ("b", "x", 1), ("b", "x", 2), ("b", None, 3),
        ("c", "0.5", 1), ("none", "1", 1)])
    got = text_counts(df, df.columns, only=only)
    assert sorted(map(tuple, got.collect())) == [
        (0, "a", "1", 3), (1, "b", "x", 2), (2, "c", "0.5", 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the join feeds the grouping
    whole = text_counts(df, df.columns)
    assert whole.count() == 10 and set(got.collect()) <= set(whole.collect())
