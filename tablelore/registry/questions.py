"""Queries that run whole recipes and lay their parts side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import recipes
from . import derived as d
from .base import TABLES, profile_sql, quality_sql, query, read, read_all
from .knowledge import STORED_SQL, _categories_sql, stored_facts
from .scans import (
    LABELLED_COLUMNS, LABELLED_SQL, _duplicates_sql, _histogram_sql, _values_sql, labelled,
)


def _others_sql() -> str:
    """The columns of all tables but orders: a join candidate has the same name in one."""
    return " union all ".join(f"select column_name from (describe select * from {t})"
                              for t in TABLES if t != "orders")


@query("table_report_orders", "K11", f"""
with q as ({quality_sql('orders', TABLES['orders'])}),
s as ({STORED_SQL})
select q.column_name, q.row_count, q.null_count, q.distinct_count, q.signals,
  case when (q.column_name = 'o_orderpriority' and exists (select 1 from orders
      where o_orderpriority not in (select unnest(string_split(valid_values, ';')) from s
        where column_name = 'o_orderpriority')))
    or (q.column_name = 'o_orderstatus' and exists (select 1 from orders
      where o_orderstatus not in (select unnest(string_split(valid_values, ';')) from s
        where column_name = 'o_orderstatus'))) then 'fail' else 'ok' end as status,
  s.description, (select count(*) from ({_others_sql()}) o
    where lower(o.column_name) = lower(q.column_name)) as join_count
from q join s using (column_name)""")
def _(spark, sf):
    parts = recipes.table_report(read_all(spark, sf), "orders", stored_facts(spark, sf),
                                 exact=True)
    joins = parts["joins"].groupBy(F.col("source_col").alias("column_name")).agg(
        F.count(F.lit(1)).alias("join_count"))
    context = parts["context"].select("column_name", "null_count", "description")
    return (
        parts["quality"].drop("null_count", "description").join(context, "column_name")
        .join(joins, "column_name", "left")
        .select("column_name", "row_count", "null_count", "distinct_count",
                F.concat_ws("; ", "signals").alias("signals"), "status", "description",
                F.coalesce("join_count", F.lit(0)).cast("bigint").alias("join_count")))


@query("feature_target_quality", "K12", f"""
with p as ({profile_sql(LABELLED_SQL, LABELLED_COLUMNS)}),
q as ({quality_sql(LABELLED_SQL, LABELLED_COLUMNS)}),
h as ({_histogram_sql(LABELLED_SQL, 'quality')})
select p.column_name, p.mean_val, p.max_length, q.uniqueness_pct, q.signals,
  case when p.column_name = 'quality' then (select string_agg(cast(bucket as varchar) || ':'
    || cast(count as varchar), ' ' order by bucket) from h) end as target_buckets
from p join q using (column_name)""")
def _(spark, sf):
    parts = recipes.feature_target(labelled(spark, sf), "documents", "quality", exact=True)
    bars = parts["target"].agg(F.array_sort(F.collect_list(F.struct("bucket", "count"))).alias(
        "b")).select(F.array_join(F.transform("b", lambda s: F.concat_ws(
            ":", s["bucket"].cast("string"), s["count"].cast("string"))), " ")).scalar()
    quality = parts["quality"].select("column_name", "uniqueness_pct", F.concat_ws(
        "; ", "signals").alias("signals"))
    return parts["profile"].join(quality, "column_name").select(
        "column_name", "mean_val", "max_length", "uniqueness_pct", "signals",
        F.when(F.col("column_name") == "quality", bars).alias("target_buckets"))


@query("wide_table_triage_lineitem", "K13 A2 K2", f"""
select column_name, category, distinct_count
from ({_categories_sql('lineitem', TABLES['lineitem'])})""")
def _(spark, sf):
    parts = recipes.wide_table_triage(read(spark, sf, "lineitem"), exact=True)
    return parts["column_category"].select("column_name", "category", "distinct_count")


@query("column_deep_dive_event_value", "K14", f"""
with h as ({_histogram_sql('events', 'value')}),
v as ({_values_sql('events', 'value', 20)})
select 'bucket' as part, cast(bucket as varchar) as label, count from h
union all select 'value', cast(value as varchar), count from v
union all select 'distinct', 'event values', count(distinct value) from events""")
def _(spark, sf):
    parts = recipes.column_deep_dive(read(spark, sf, "events"), "events", "value")
    return (
        parts["distribution"].select(F.lit("bucket").alias("part"),
                                     F.col("bucket").cast("string").alias("label"), "count")
        .unionByName(parts["values"].select(
            F.lit("value").alias("part"), F.col("value").cast("string").alias("label"),
            "count"))
        .unionByName(parts["summary"].select(
            F.lit("distinct").alias("part"), F.lit("event values").alias("label"),
            F.col("distinct_count").alias("count"))))


def _summary_sql(table: str) -> str:
    return f"""
with p as ({profile_sql(table, TABLES[table], quick=True)}),
q as ({quality_sql(table, TABLES[table])})
select p.column_name, p.column_type, p.total_rows, p.null_pct, q.uniqueness_pct, q.min_text,
  q.max_text, q.signals, q.status from p join q using (column_name)"""


def _summary(parts):
    quality = parts["quality"].select(
        "column_name", "uniqueness_pct", "min_text", "max_text",
        F.concat_ws("; ", "signals").alias("signals"), "status")
    return (
        parts["schema"].select("column_name")
        .join(parts["profile"].select("column_name", "column_type", "total_rows", "null_pct"),
              "column_name")
        .join(quality, "column_name"))


@query("table_summary_customer", "K15", _summary_sql("customer"))
def _(spark, sf):
    return _summary(recipes.table_summary(read(spark, sf, "customer"), "customer", exact=True))


@query("table_handoff_part", "K15", _summary_sql("part"))
def _(spark, sf):
    return _summary(recipes.table_handoff(read(spark, sf, "part"), "part", exact=True))


# The snapshot of events taken before the middle of the month: a column less, another
# type, and the rows written by then.
_SNAPSHOT_SQL = f"""(select count(*) from events where ts < timestamp '{d.MIDDLE}')"""


_SPARK_TYPE_SQL = """case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
  when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'FLOAT' then 'float'
  when 'BOOLEAN' then 'boolean' else 'timestamp_ntz' end"""


def _columns_sql(table: str) -> str:
    """Names and Spark types of a table's columns, as SQL reads them."""
    return f"""select column_name, {_SPARK_TYPE_SQL} as data_type
  from (describe select * from {table})"""


def _change_sql(left: str, right: str) -> str:
    """Columns of two listings, and how the right one differs."""
    return f"""select coalesce(l.column_name, r.column_name) as column_name,
  case when l.column_name is null then 'added' when r.column_name is null then 'removed'
    when l.data_type <> r.data_type then 'changed' else 'unchanged' end as change
from ({left}) l full join ({right}) r using (column_name)"""


_SNAPSHOT_COLUMNS = (
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "int"),
    ("event_type", "string"), ("value", "double"), ("session", "string"))


@query("table_investigate_events", "K15 D2", f"""
with q as ({quality_sql('events', TABLES['events'])}),
v as ({_values_sql('events', 'event_type', 20)}),
snap(column_name, data_type) as (values {", ".join(map(str, _SNAPSHOT_COLUMNS))}),
c as ({_change_sql('select * from snap', _columns_sql('events'))})
select c.column_name, q.row_count, q.signals, c.change,
  (select count(*) from events) - {_SNAPSHOT_SQL} as row_count_delta,
  (select count(*) from v) as focus_values
from c left join q using (column_name)""")
def _(spark, sf):
    events = read(spark, sf, "events")
    snapshot = events.where(F.col("ts") < d.middle()).agg(
        F.max("ts").alias("taken_at"), F.count(F.lit(1)).alias("row_count")
    ).select(
        "taken_at", "row_count", F.lit("events").alias("table_name"), F.lit(True).alias(
            "nullable"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"))
                           for c, t in _SNAPSHOT_COLUMNS])))
    # The newest snapshots of many other tables lie in the same place.
    parts = recipes.table_investigate(events, "events",
                                      snapshots=snapshot.unionByName(d.snapshots(spark, sf)),
                                      focus="event_type", exact=True)
    focus = parts["values"].agg(F.count(F.lit(1))).scalar()
    quality = parts["quality"].select("column_name", "row_count", F.concat_ws(
        "; ", "signals").alias("signals"))
    return parts["since"].select("column_name", "change", "row_count_delta").join(
        quality, "column_name", "left").withColumn("focus_values", focus)


_LEFT_SQL = "(select o_orderkey, o_custkey, o_totalprice from orders)"
_RIGHT_SQL = """(select o_orderkey, cast(o_custkey as varchar) as o_custkey,
  cast(year(o_orderdate) as integer) as o_year from orders)"""


@query("schema_compare_halves", "K16 D1 D4 D5", f"""
with l as ({_columns_sql(_LEFT_SQL)}), r as ({_columns_sql(_RIGHT_SQL)}),
n as (select count(*) as right_rows from {_RIGHT_SQL})
select 'orders' as pair, right_rows, column_name, change
from ({_change_sql('select * from l', 'select * from r')}), n
union all
select 'join ' || l.column_name || ' = ' || r.column_name, right_rows, 'exact_name',
  case when l.data_type = r.data_type then '0.9' else '0.5' end
from l join r using (column_name), n""")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    left = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    right = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"),
                          F.year("o_orderdate").alias("o_year"))
    parts = recipes.schema_compare({"left": left, "right": right}, "left", "right")
    rows = right.agg(F.count(F.lit(1))).scalar()
    return parts["diff"].select(
        F.lit("orders").alias("pair"), "column_name", "change"
    ).unionByName(parts["joins"].select(
        F.concat(F.lit("join "), "source_col", F.lit(" = "), "target_col").alias("pair"),
        F.col("match_type").alias("column_name"),
        F.col("confidence").cast("string").alias("change"))
    ).withColumn("right_rows", rows)


def _null_columns_sql(table: str, columns) -> str:
    return " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as nulls "
                              f"from {table}" for c in columns)


@query("migration_check_labels", "D4 D5 Q7 K16", f"""
with n as (select (select count(*) from labels) as b, (select count(*) from {LABELLED_SQL}) as a),
c as ({_change_sql(_columns_sql('labels'), _columns_sql(LABELLED_SQL))}),
w as (select count(*) as worse from ({_null_columns_sql('labels', TABLES['labels'])}) x
  join ({_null_columns_sql(LABELLED_SQL, TABLES['labels'])}) y using (column_name)
  where y.nulls > x.nulls)
select b as before_rows, a as after_rows, abs(a - b) * cast(100 as double) / b as drift_pct,
  abs(a - b) * cast(100 as double) / b <= 1.0 as passed,
  (select count(*) from c where change = 'added') as added,
  (select count(*) from c where change = 'removed') as removed,
  worse as columns_with_new_nulls from n, w""")
def _(spark, sf):
    parts = recipes.migration_check(read(spark, sf, "labels"), labelled(spark, sf))
    counted = parts["schema"].agg(F.struct(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"))).scalar()
    worse = parts["nulls"].agg(F.count(F.lit(1))).scalar()
    return parts["drift"].withColumns({
        "added": counted.added, "removed": counted.removed,
        "columns_with_new_nulls": worse})


@query("quality_gate_lineitem", "K15 A14 Q1", f"""
select q.column_name, q.status, q.signals, dup.duplicate_rows
from ({quality_sql('lineitem', TABLES['lineitem'])}) q,
  ({_duplicates_sql('lineitem', ', '.join(TABLES['lineitem']))}) dup""")
def _(spark, sf):
    from ..operators.quality import duplicate_rows

    lineitem = read(spark, sf, "lineitem")
    copies = duplicate_rows(lineitem).select("duplicate_rows").scalar()
    rows = recipes.table_summary(lineitem, "lineitem", exact=True)["quality"]
    return rows.select("column_name", "status", F.concat_ws("; ", "signals").alias("signals")
                       ).withColumn("duplicate_rows", copies)
