"""Queries on sources, profiles, values and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pivot import model_metrics, pivot
from ..operators.profile import approx_top_values, profile
from ..operators.profile_states import current_states, profile_of_states, refresh_states
from ..operators.quality import duplicate_rows
from ..operators.values import (
    categories, distinct_values, histogram, sample_values, top_values, values_summary,
)
from ..sources.rows import (
    capped_query, capped_query_summary, preview, scratch, select_rows, sort_rows,
)
from ..sources.sampling import (
    block_sample, modulus_sample, percent_sample, plan_scan, sample_rows,
)
from ..sources.tables import (
    catalog, inspect, list_tables, open_tables, row_counts, row_counts_of, search_catalog,
)
from ..store import temporary_folder
from .base import TABLES, profile_sql, query, read, read_all

LABELLED_COLUMNS = {**TABLES["documents"], "quality": "int", "toxic": "int"}
LABELLED_SQL = "(select d.*, l.quality, l.toxic from documents d left join labels l " \
               "on d.doc_id = l.doc_id)"


def labelled(spark, sf):
    """Documents with their labels where there are any: the table with nulls."""
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")


# --- sources ----------------------------------------------------------------------

_COUNTS_SQL = "\nunion all\n".join(
    f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES)


def _catalog_sql(where: str = "true") -> str:
    rows = ", ".join(
        f"('{t}', {i}, '{c}', '{k}')"
        for t, cols in TABLES.items() for i, (c, k) in enumerate(cols.items(), start=1))
    return f"""
with counts as ({_COUNTS_SQL}),
cols(table_name, ordinal, column_name, data_type) as (values {rows})
select cols.table_name, cast(ordinal as integer) as ordinal, column_name, data_type,
  row_count from cols join counts using (table_name) where {where}"""


@query("row_counts_all", "S1 S4 S5 U1", _COUNTS_SQL)
def _(spark, sf):
    return row_counts(open_tables(spark, {t: f"{sf}/{t}.parquet" for t in TABLES}))


@query("row_shares_of_files", "S4 U1", f"""
select table_name, row_count,
  round(100.0 * row_count / sum(row_count) over (), 2) as share_pct from ({_COUNTS_SQL})""")
def _(spark, sf):
    counts = row_counts_of(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn(
        "share_pct", F.round(F.try_divide(100.0 * F.col("row_count"), total), 2))


@query("tables_listed", "S2 S4", f"""
select table_name, 'view' as table_type, row_count from ({_COUNTS_SQL})""")
def _(spark, sf):
    tables = open_tables(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})
    # The session may know other tables; counting keeps to the ones opened here.
    return list_tables(spark).join(row_counts(tables), "table_name")


@query("catalog_all", "S3 S7", _catalog_sql())
def _(spark, sf):
    return catalog(read_all(spark, sf)).select(
        "table_name", "ordinal", "column_name", "data_type", "row_count")


@query("catalog_search_key", "S8", _catalog_sql(
    "table_name in (select table_name from cols where lower(table_name) like '%custkey%' "
    "or lower(column_name) like '%custkey%')"))
def _(spark, sf):
    return search_catalog(catalog(read_all(spark, sf)), "CustKey").select(
        "table_name", "ordinal", "column_name", "data_type", "row_count")


@query("inspect_orders", "S3 S5 S6", _catalog_sql("table_name = 'orders'"))
def _(spark, sf):
    return inspect(read(spark, sf, "orders"), "orders").select(
        "table_name", "ordinal", "column_name", "data_type", "row_count")


@query("preview_orders", "S10", "select * from orders order by o_orderkey limit 20")
def _(spark, sf):
    return preview(read(spark, sf, "orders"), order_by=["o_orderkey"])


@query("scratch_orders", "S16",
       "select * from orders order by o_orderdate, o_orderkey limit 50")
def _(spark, sf):
    return scratch(read(spark, sf, "orders"), "orders", 50, ["o_orderdate", "o_orderkey"])


@query("sample_modulus_orders", "S13",
       "select * from orders where o_orderkey % (select greatest(count(*) // 1000, 1) "
       "from orders) = 0")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    return modulus_sample(orders, F.col("o_orderkey"), 1000, orders.count())


def _drawn(whole, sample, share, spread):
    """The table's rows, and whether a sample is of the wanted size and from all over it.

    ``spread`` is the number of rows that come or stay away together.
    """
    def measures(df, prefix):
        return df.agg(F.count(F.lit(1)).alias(f"{prefix}_rows"),
                      F.avg("l_orderkey").alias(f"{prefix}_mean"),
                      F.stddev_pop("l_orderkey").alias(f"{prefix}_spread"))

    wanted = F.col("all_rows") * share
    groups = F.greatest(wanted / spread, F.lit(1.0))
    return measures(whole, "all").join(measures(sample, "own")).select(
        F.col("all_rows"),
        (F.abs(F.col("own_rows") - wanted) <= 6 * F.sqrt(groups) * spread).alias("right_size"),
        (F.abs(F.col("own_mean") - F.col("all_mean"))
         <= 6 * F.col("all_spread") / F.sqrt(groups)).alias("unbiased"))


_DRAWN = "select count(*) as all_rows, true as right_size, true as unbiased from lineitem"


@query("sample_percent_lineitem", "S12", _DRAWN)
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem")
    return _drawn(lineitem, percent_sample(lineitem, 5.0, seed=7), 0.05, 1)


# Blocks come whole: all but the last of a file hold as many rows as asked for.
@query("sample_blocks_lineitem", "S12", """
select count(*) as all_rows, ceil(count(*) / 100.0) as all_blocks, true as right_size,
  true as unbiased, true as whole_blocks from lineitem""")
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem")
    drawn = block_sample(lineitem, 20.0, seed=7, block_rows=100)
    meta = drawn.metadataColumn("_metadata")
    blocks = drawn.groupBy(meta["file_path"], F.floor(meta["row_index"] / 100)).count()
    whole = blocks.agg(F.count_if(F.col("count") != 100).alias("cut")).select(
        (F.col("cut") <= max(len(lineitem.inputFiles()), 1)).alias("whole_blocks"))
    return _drawn(lineitem, drawn, 0.2, 100).join(whole).select(
        "all_rows", F.ceil(F.col("all_rows") / 100).cast("double").alias("all_blocks"),
        "right_size", "unbiased", "whole_blocks")


@query("sample_rows_lineitem", "S11", """
select count(*) as all_rows, true as right_size, true as unbiased,
  least(1000, count(*)) as drawn_rows, least(1000, count(*)) as different_rows from lineitem""")
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem")
    total = lineitem.count()
    drawn = sample_rows(lineitem, 1000, total, seed=7)
    exact = drawn.agg(
        F.count(F.lit(1)).alias("drawn_rows"),
        F.countDistinct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
            "different_rows"))
    return _drawn(lineitem, drawn, 1000 / total, 1).join(exact)


@query("sampled_profile_lineitem", "S14 A1", """
select count(*) as row_count, 11 as columns, true as sampled, 2000 as scanned
from lineitem""")
def _(spark, sf):
    rows = profile(plan_scan(read(spark, sf, "lineitem"), sample=2_000))
    return rows.groupBy("row_count").agg(
        F.count(F.lit(1)).cast("int").alias("columns"), F.every("sampled").alias("sampled"),
        F.max("total_rows").cast("int").alias("scanned"))


@query("select_open_orders", "P1 P2 S15", """
select o_orderkey, o_custkey, o_totalprice from orders
where o_orderstatus = 'O' and o_totalprice > 100000""")
def _(spark, sf):
    return select_rows(read(spark, sf, "orders"),
                       ["O_OrderKey", "o_custkey", "o_totalprice"],
                       "o_orderstatus = 'O' and o_totalprice > 100000")


@query("sort_customers", "P6", "select * from customer order by c_acctbal desc nulls first")
def _(spark, sf):
    return sort_rows(read(spark, sf, "customer"), "C_ACCTBAL", descending=True)


_PART_SQL = "select p_brand, p_type, count(*) as n, max(p_size) as max_size from part " \
            "group by p_brand, p_type order by n desc, p_brand, p_type"


@query("capped_query_parts", "L1", f"select * from ({_PART_SQL}) limit 50")
def _(spark, sf):
    open_tables(spark, {"part": f"{sf}/part.parquet"})
    return capped_query(spark, _PART_SQL + ";", 50)


@query("capped_query_summary_parts", "L1", f"""
select count(*) as row_count, count(*) >= 50 as limited from ({_PART_SQL} limit 50)""")
def _(spark, sf):
    open_tables(spark, {"part": f"{sf}/part.parquet"})
    return capped_query_summary(spark, _PART_SQL, 50)


# --- profile ----------------------------------------------------------------------

_PROFILE = ("column_name", "column_type", "total_rows", "null_count", "null_pct",
            "distinct_count", "min_val", "max_val", "min_text", "max_text", "mean_val",
            "median_val", "stddev_val", "min_length", "max_length")


def _exact(df, *more):
    return profile(df, exact=True).withColumn(
        "median_val", F.round("median_val", 4)).select(*_PROFILE, *more)


for _table in ("lineitem", "orders", "events", "customer", "part", "conversations"):
    @query(f"profile_{_table}", "A1 A3 A5 P3", profile_sql(_table, TABLES[_table]))
    def _(spark, sf, _t=_table):
        return _exact(read(spark, sf, _t))


# Without a wish for a sample the plan is to read everything.
@query("profile_planned_lineitem", "S14 A1", f"""
select p.*, total_rows as row_count, false as sampled
from ({profile_sql("lineitem", TABLES["lineitem"])}) p""")
def _(spark, sf):
    return _exact(plan_scan(read(spark, sf, "lineitem")), "row_count", "sampled")


@query("profile_labelled_documents", "A1 A3 A5 P3",
       profile_sql(LABELLED_SQL, LABELLED_COLUMNS))
def _(spark, sf):
    return _exact(labelled(spark, sf))


@query("profile_quick_customer", "A2 A3",
       profile_sql("customer", TABLES["customer"], quick=True))
def _(spark, sf):
    return profile(read(spark, sf, "customer"), quick=True, exact=True).select(*_PROFILE[:6])


@query("profile_batched_lineitem", "A7",
       profile_sql("lineitem", TABLES["lineitem"], quick=True))
def _(spark, sf):
    return profile(read(spark, sf, "lineitem"), quick=True, exact=True,
                   batch_columns=4).select(*_PROFILE[:6])


@query("profile_columns_orders", "A1 P1", profile_sql(
    "orders", {c: TABLES["orders"][c] for c in ("o_totalprice", "o_orderpriority")}))
def _(spark, sf):
    return profile(read(spark, sf, "orders"), "O_TOTALPRICE, o_orderpriority", exact=True
                   ).withColumn("median_val", F.round("median_val", 4)).select(*_PROFILE)


def _near(rows, exact, columns, error=0.05):
    """Whether sketched numbers are within the error of the exact ones, per column."""
    own = rows.select("column_name", *columns)
    true = exact.select("column_name", *(F.col(c).alias(f"true_{c}") for c in columns))
    return own.join(true, "column_name").select("column_name", *(
        F.coalesce(F.abs(F.col(c) - F.col(f"true_{c}")) <= error * F.abs(F.col(f"true_{c}")),
                   F.col(c).eqNullSafe(F.col(f"true_{c}"))).alias(f"{c}_near")
        for c in columns))


# A table grows by files; each refresh reads the new ones, and the states of all are merged.
@query("profile_refreshed_orders", "F3 D2 A1", f"""
select * exclude (distinct_count, median_val), true as distinct_count_near,
  true as median_val_near, 2 as first_files, 1 as second_files, 0 as third_files
from ({profile_sql("orders", TABLES["orders"])})""")
def _(spark, sf):
    orders, folder = read(spark, sf, "orders"), temporary_folder(spark, "profile")
    table, states = f"{folder}/table", f"{folder}/states"
    third = F.col("o_orderkey") % 3
    orders.where(third < 2).repartition(2).write.parquet(table)
    first = refresh_states(spark, table, states)
    orders.where(third == 2).coalesce(1).write.mode("append").parquet(table)
    second = refresh_states(spark, table, states)
    third = refresh_states(spark, table, states)
    rows = profile_of_states(current_states(spark, table, states))
    near = _near(rows, profile(orders, exact=True), ("distinct_count", "median_val"))
    return rows.select(*(c for c in _PROFILE if c not in ("distinct_count", "median_val"))).join(
        near, "column_name").withColumns({
            "first_files": F.lit(len(first)), "second_files": F.lit(len(second)),
            "third_files": F.lit(len(third))})


@query("profile_approx_lineitem", "A4 A6", f"""
select column_name, true as distinct_count_near, true as median_val_near
from ({profile_sql("lineitem", TABLES["lineitem"])})""")
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem")
    return _near(profile(lineitem), profile(lineitem, exact=True),
                 ("distinct_count", "median_val"))


# --- values -----------------------------------------------------------------------

def _top_sql(table: str, columns, top: int) -> str:
    parts = []
    for pos, c in enumerate(columns):
        parts.append(f"""
select {pos} as pos, '{c}' as column_name, cast(rank as integer) as rank, value, count,
  (select count({c}) from {table}) as non_null_rows,
  (select count(*) from {table}) as total_rows,
  (select count(*) - count({c}) from {table}) as null_count
from (select cast({c} as varchar) as value, count(*) as count,
        row_number() over (order by count(*) desc, cast({c} as varchar)) as rank
      from {table} where {c} is not null group by {c})
where rank <= {top}""")
    return "\nunion all\n".join(parts)


@query("top_values_orders", "A8 W1 W2", _top_sql("orders", TABLES["orders"], 5))
def _(spark, sf):
    return top_values(read(spark, sf, "orders"), top=5)


@query("top_values_documents", "A8", _top_sql(
    LABELLED_SQL, ("text", "lang", "source", "quality", "toxic"), 10))
def _(spark, sf):
    return top_values(labelled(spark, sf), ["text", "lang", "source", "quality", "toxic"])


@query("approx_top_event_type", "A9", """
select event_type as value, count(*) as count, (select count(*) from events) as total_rows
from events group by event_type""")
def _(spark, sf):
    return approx_top_values(read(spark, sf, "events"), ["event_type"], 10).select(
        "value", "count", "total_rows")


@query("approx_top_lineitem", "A9", f"""
with t as ({_top_sql("lineitem", ("l_returnflag", "l_linestatus", "l_linenumber"), 5)})
select column_name, value, count, total_rows from t""")
def _(spark, sf):
    lineitem = read(spark, sf, "lineitem")
    # Fewer values than the sketch has slots: its counts are exact.
    return approx_top_values(lineitem, "l_returnflag,l_linestatus,l_linenumber", top=5
                             ).select("column_name", "value", "count", "total_rows")


@query("sample_values_part", "A15 U2", "\nunion all\n".join(f"""
select {i} as pos, '{c}' as column_name, value, cast(rank as integer) as rank from (
  select value, row_number() over (order by value) as rank
  from (select distinct cast({c} as varchar) as value from part where {c} is not null))
where rank <= 25""" for i, c in enumerate(TABLES["part"])))
def _(spark, sf):
    return sample_values(read(spark, sf, "part"))


def _values_sql(table: str, column: str, most: int) -> str:
    return f"""
with g as (select {column} as value, count(*) as count from {table} group by {column})
select value, count,
  cast((select sum(count) from g) as bigint) as total_rows,
  cast(coalesce((select count from g where value is null), 0) as bigint) as null_count,
  (select count(value) from g) as distinct_count,
  (select count(value) from g) > {most} as truncated
from g where value is not null order by count desc, value limit {most}"""


@query("values_custkey_all", "A10 L4", """
select o_custkey as value, count(*) as count, (select count(distinct o_custkey) from orders)
  as distinct_count, false as truncated from orders group by o_custkey""")
def _(spark, sf):
    return distinct_values(read(spark, sf, "orders"), "o_custkey").select(
        "value", "count", "distinct_count", "truncated")


@query("values_event_type", "A10 L3", _values_sql("events", "event_type", 1000))
def _(spark, sf):
    return distinct_values(read(spark, sf, "events"), "EVENT_TYPE")


@query("values_customers_truncated", "A10 L2 L3", _values_sql("orders", "o_custkey", 100))
def _(spark, sf):
    return distinct_values(read(spark, sf, "orders"), "o_custkey", 100, "frequency")


@query("values_quality_nulls", "A10 L4", _values_sql(LABELLED_SQL, "quality", 1000))
def _(spark, sf):
    return distinct_values(labelled(spark, sf), "quality")


@query("values_summary_toxic", "A10 L2", f"""
select count(*) as total_rows, count(*) - count(toxic) as null_count,
  count(distinct toxic) as distinct_count, count(distinct toxic) > 1 as truncated
from {LABELLED_SQL}""")
def _(spark, sf):
    return values_summary(labelled(spark, sf), "toxic", 1)


def _histogram_sql(source: str, column: str, buckets: int = 20) -> str:
    return f"""
with t as (select cast({column} as double) as x from {source}),
e as (select min(x) as lo, max(x) as hi, count(*) as n, count(*) - count(x) as nulls from t),
b as (select case when hi = lo then 0
  else least(floor((x - lo) * {buckets} / (hi - lo)), {buckets - 1}) end as bucket,
  lo, hi, n, nulls from t, e where x is not null)
select cast(bucket as bigint) as bucket, lo + bucket * ((hi - lo) / {buckets}) as bucket_min,
  case when bucket = {buckets - 1} then hi
    else lo + (bucket + 1) * ((hi - lo) / {buckets}) end as bucket_max,
  count(*) as count, n as total_rows, nulls as null_count
from b group by bucket, lo, hi, n, nulls"""


@query("histogram_extendedprice", "A11", _histogram_sql("lineitem", "l_extendedprice"))
def _(spark, sf):
    return histogram(read(spark, sf, "lineitem"), "l_extendedprice")


@query("histogram_event_value", "A11", _histogram_sql("events", "value", 50))
def _(spark, sf):
    return histogram(read(spark, sf, "events"), "value", 50)


@query("histogram_quality_nulls", "A11", _histogram_sql(LABELLED_SQL, "quality", 4))
def _(spark, sf):
    return histogram(labelled(spark, sf), "quality", 4)


@query("histogram_constant", "A11",
       _histogram_sql("(select n_chars * 0 + 42 as c from documents)", "c"))
def _(spark, sf):
    return histogram(read(spark, sf, "documents").select(
        (F.col("n_chars") * 0 + 42).alias("c")), "c")


@query("categories_returnflag", "A12", """
with g as (select l_returnflag as value, count(*) as count from lineitem group by 1)
select value, count, 
  cast(printf('%.1f', cast(100.0 * count / sum(count) over () as double)) as double)
    as listed_pct,
  cast((select sum(count) from g) as bigint) as non_null_rows,
  cast((select sum(count) from g) as bigint) as total_rows, 0 as null_count from g""")
def _(spark, sf):
    return categories(read(spark, sf, "lineitem"), "l_returnflag").withColumn(
        "null_count", F.col("null_count").cast("int"))


@query("categories_sources_top", "A12", """
with g as (select source as value, count(*) as count from documents group by 1),
t as (select * from g order by count desc, value limit 5)
select value, count, 
  cast(printf('%.1f', cast(100.0 * count / sum(count) over () as double)) as double)
    as listed_pct,
  (select count(source) from documents) as non_null_rows,
  (select count(*) from documents) as total_rows,
  (select count(*) - count(source) from documents) as null_count from t""")
def _(spark, sf):
    return categories(read(spark, sf, "documents"), "source", 5)


# --- pivots, duplicates, metrics ---------------------------------------------------

@query("pivot_sum_by_flag", "A13", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_l_quantity,
  round(sum(l_extendedprice), 2) as sum_l_extendedprice
from lineitem group by l_returnflag, l_linestatus""")
def _(spark, sf):
    out = pivot(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                ["l_quantity", "l_extendedprice"], "sum")
    return out.withColumns({c: F.round(c, 2) for c in out.columns[2:]})


@query("pivot_count_star_quality", "A13", f"""
select quality, count(*) as count_star, count(toxic) as count_toxic
from {LABELLED_SQL} group by quality""")
def _(spark, sf):
    return pivot(labelled(spark, sf), ["quality"], ["*", "toxic"], "COUNT")


@query("pivot_filter_limit", "A13 P2 L3", """
select o_custkey, max(o_totalprice) as max_o_totalprice from orders
where o_orderstatus <> 'P' group by o_custkey
order by max_o_totalprice desc, o_custkey limit 25""")
def _(spark, sf):
    return pivot(read(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], "max",
                 "o_orderstatus <> 'P'", [F.desc("max_o_totalprice"), "o_custkey"], 25)


def _duplicates_sql(table: str, columns: str) -> str:
    return f"""
select cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_rows,
  count(*) as duplicated_groups
from (select count(*) as n from {table} group by {columns} having count(*) > 1)"""


_LINE_KEY = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]


@query("duplicates_projection", "A14 Q4 P5", _duplicates_sql("lineitem", ", ".join(_LINE_KEY)))
def _(spark, sf):
    return duplicate_rows(read(spark, sf, "lineitem"), _LINE_KEY)


@query("duplicates_hash_first", "A14 Q4 P5", _duplicates_sql("documents", "text, lang"))
def _(spark, sf):
    return duplicate_rows(read(spark, sf, "documents"), ["text", "lang"], hash_first=True)


@query("duplicates_lineitem", "A14 Q4",
       _duplicates_sql("lineitem", ", ".join(TABLES["lineitem"])))
def _(spark, sf):
    return duplicate_rows(read(spark, sf, "lineitem"))


@query("metrics_by_segment", "A16", """
select c_mktsegment, count(*) as row_count, cast(sum(c_custkey) as bigint) as sum_c_custkey,
  cast(sum(c_nationkey) as bigint) as sum_c_nationkey, round(sum(c_acctbal), 2) as sum_c_acctbal
from customer group by c_mktsegment""")
def _(spark, sf):
    return model_metrics(read(spark, sf, "customer"), "c_mktsegment").withColumn(
        "sum_c_acctbal", F.round("sum_c_acctbal", 2))


@query("metrics_by_status", "A16", """
select l_linestatus, count(*) as row_count, round(sum(l_quantity), 2) as sum_l_quantity,
  round(avg(l_tax), 6) as avg_tax_rate, round(avg(l_discount), 6) as avg_discount_pct
from lineitem group by l_linestatus""")
def _(spark, sf):
    lines = read(spark, sf, "lineitem").select(
        "l_linestatus", "l_quantity", F.col("l_tax").alias("tax_rate"),
        F.col("l_discount").alias("discount_pct"), F.col("l_orderkey").alias("order_id"))
    out = model_metrics(lines, "l_linestatus")
    return out.select("l_linestatus", "row_count", F.round("sum_l_quantity", 2).alias(
        "sum_l_quantity"), F.round("avg_tax_rate", 6).alias("avg_tax_rate"),
        F.round("avg_discount_pct", 6).alias("avg_discount_pct"))
