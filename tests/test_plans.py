"""Plans that must hold when one key owns a third of the rows."""

import pytest
from pyspark.sql import functions as F

from tablelore.operators import counts, knowledge
from tablelore.operators.diff import latest_snapshot
from tablelore.operators.facts import best_of_bundles, current_facts, undo
from tablelore.operators.joins import key_evidence
from tablelore.operators.profile import profile
from tablelore.operators.quality import duplicate_rows, quality
from tablelore.operators.search import rank_documents
from tablelore.operators.values import distinct_values, histogram, top_values

HOT = 30_000


@pytest.fixture
def skewed(spark):
    """A third of the rows is one copied row."""
    ids = spark.range(3 * HOT)
    hot = F.col("id") < HOT
    return ids.select(
        F.when(hot, -1).otherwise(F.col("id") % 5000).alias("k"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 999)).alias("s"),
        F.when(hot, 0.5).otherwise(F.col("id") / 7).alias("x"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df, name):
    """Largest number of rows any shuffle of a finished query wrote."""
    df.collect()
    node, most = [df._jdf.queryExecution().executedPlan()], 0
    while node:
        p = node.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            node.append(p.plan())
            continue
        metrics = p.metrics()
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            most = max(most, metrics.apply("shuffleRecordsWritten").value())
        children = p.children()
        node.extend(children.apply(i) for i in range(children.size()))
    return most


def test_hot_values_shrink_before_the_shuffle(skewed):
    df = skewed.coalesce(4)
    # 4 tasks, 5001 keys: far fewer records than rows cross the shuffle.
    assert shuffled(distinct_values(df, "k", 10), "k") <= 4 * 5001
    row = distinct_values(df, "k", 10).collect()
    assert {r.total_rows for r in row} == {3 * HOT}


def test_exact_profile_of_skewed_columns(skewed):
    rows = {r.column_name: r for r in profile(skewed, exact=True).collect()}
    assert rows["k"].distinct_count == 5001 and rows["s"].distinct_count == 1000
    expected = skewed.selectExpr("percentile(k, 0.5)", "percentile(x, 0.5)").collect()[0]
    assert (rows["k"].median_val, rows["x"].median_val) == tuple(expected)


def test_hot_copies(skewed):
    row = duplicate_rows(skewed).collect()[0]
    assert row.duplicate_rows == HOT - 1
    assert duplicate_rows(skewed, hash_first=True).collect()[0] == row


def test_hot_join_keys_are_counted_once(skewed):
    row = key_evidence(skewed, "k", skewed, "k").collect()[0]
    sizes = skewed.groupBy("k").count().selectExpr("sum(count * count)").collect()[0][0]
    assert row.joined_rows == sizes and row.containment == 1.0
    # The join reuses the partitioning of the counts: two exchanges for the two sides
    # and one for the single result row.
    assert plan(key_evidence(skewed, "k", skewed, "s")).count("Exchange") <= 4


def test_ranks_are_cut_before_their_shuffle(skewed):
    assert plan(top_values(skewed, top=5)).count("WindowGroupLimit") == 2


def test_statistics_shuffle_one_row_per_task(skewed):
    for df in (profile(skewed), profile(skewed, quick=True), quality(skewed),
               knowledge.small_value_sets(skewed), histogram(skewed, "x")):
        assert "Exchange hashpartitioning(v_" not in plan(df)
        assert "Generate inline(array(struct(pos, 0, v_" not in plan(df)
    assert shuffled(profile(skewed.coalesce(4)), "profile") <= 4


def test_search_does_not_shuffle_documents(skewed):
    df = rank_documents(skewed, "v1 hot", {"s": 1}, order=("k", "x"), limit=5)
    text = plan(df)
    assert "hashpartitioning" not in text and "TakeOrderedAndProject" in text


def test_plain_statistics_are_compiled(skewed):
    from tablelore.operators.profile import _column_stats, per_column

    df = per_column(skewed, skewed.columns,
                    lambda i, c: _column_stats(skewed, i, c, False))
    df.collect()
    assert "*(1) HashAggregate" in plan(df) and "ObjectHash" not in plan(df)


def test_one_scan_column_pruning(spark, tmp_path):
    path = f"{tmp_path}/wide"
    spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(30)]).write.parquet(path)
    df = profile(spark.read.parquet(path), ["c3", "c7"])
    reads = [line for line in plan(df).splitlines() if "ReadSchema" in line]
    assert reads and all("struct<c3:bigint,c7:bigint>" in line for line in reads)


def test_filters_reach_the_file(spark, tmp_path):
    from tablelore.sources.rows import select_rows

    path = f"{tmp_path}/rows"
    spark.range(10).select("id", (F.col("id") * 2).alias("b")).write.parquet(path)
    text = plan(select_rows(spark.read.parquet(path), ["b"], "id > 3"))
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in text


def test_hot_table_in_the_fact_log(spark):
    log = spark.range(HOT).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50))
        .alias("table_name"), F.concat(F.lit("c"), F.col("id") % 20).alias("column_name"),
        F.lit("pii").alias("field"), F.col("id").cast("string").alias("value"),
        F.lit(None).cast("array<string>").alias("values"), F.lit("scan").alias("source"),
        (F.col("id") % 10 / 10).alias("confidence"),
        F.timestamp_seconds("id").alias("written_at"), F.lit("a").alias("author"),
        F.lit(None).cast("string").alias("session"), F.col("id").alias("write_id"))
    now = {(r.table_name, r.column_name): r.write_id for r in current_facts(log).collect()}
    assert now["hot", "c19"] == 29979 and len(now) == 20 + 100
    undone = undo(log, 5)
    assert undone.where("table_name = 'hot'").count() == HOT / 3 - 5
    assert undone.count() == HOT - 5 * 51
    best = best_of_bundles(log.withColumn("bundle", F.lit("b"))).collect()
    assert len(best) == len(now)


def test_hot_table_among_snapshots(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7))
        .alias("table_name"), F.concat(F.lit("c"), F.col("id") % 11).alias("column_name"),
        F.lit("int").alias("data_type"), F.lit(True).alias("nullable"),
        F.floor(F.col("id") / 33).alias("taken_at"), F.lit(1).alias("row_count"))
    newest = {r.table_name: r.taken_at for r in latest_snapshot(rows).collect()}
    assert newest["hot"] == 8997 // 33


def test_wide_unfolding_happens_in_passes(spark):
    df = spark.range(5).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(60)])
    assert plan(counts.value_counts(df, df.columns)).count("Generate inline") == 3
    assert counts.value_counts(df, df.columns).agg(F.sum("n")).collect()[0][0] == 300
